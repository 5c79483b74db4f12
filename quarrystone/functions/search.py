"""Full-text search over an inverted index: word stems and a length-normed rank, as SQL of a dialect.

The index (``postings``) has a row for each stem and document with its occurrences and the document's words. It is stored in
ranges of stems, each file sorted, so that a search reads the row groups that may hold its stems and no others."""

from __future__ import annotations

import re

from quarrystone.functions.names import quoted

#: Endings that a stem of three letters or more loses, once.
ENDINGS = "(ingly|edly|ings|ing|ies|ied|ed|es|s|ly)$"


def stem(d, w: str) -> str:
    """The stem of a lower-case word."""
    bare = d.rx_rep(w, ENDINGS, "")
    return f"CASE WHEN length({bare}) >= 3 THEN {bare} ELSE {w} END"


def stems(words: str) -> list[str]:
    """The different stems of a search, in order; what is not a letter parts words, and single letters are no words."""
    found = [w for w in re.findall("[a-z]+", words.lower()) if len(w) > 1]
    bare = [re.sub(ENDINGS, "", w) for w in found]
    return sorted({b if len(b) >= 3 else w for b, w in zip(bare, found)})


def ranked(d, words: str) -> str:
    """(doc_id, hits, score) of the documents that hold every stem of ``words``: the sum over stems of occurrences times ln(1 +
    documents / documents with the stem), divided by 1 + ln(the document's words). No words find nothing."""
    held = stems(words)
    some = f"SELECT term, doc_id, tf, length FROM postings WHERE term IN ({quoted(held) if held else 'NULL'})"
    return f"""SELECT doc_id, CAST(sum(tf) AS BIGINT) AS hits, round(sum(tf * ln(1 + n / CAST(df AS DOUBLE))) / (1 + ln(length)), 6) AS score FROM ({some}) p JOIN (SELECT term AS t, count(*) AS df FROM ({some}) q GROUP BY term) f ON term = t
        CROSS JOIN (SELECT count(*) AS n FROM documents) c GROUP BY doc_id, length HAVING count(*) = {len(held)}"""
