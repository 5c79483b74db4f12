"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Every document is factored greedily against the reference blocks, which together hold all documents: where the next
``window`` words also stand in a document with a smaller id, a factor opens with the longest match there is in such a
document, found in the block's suffix order and extended for as long as text and source go on alike. Where they don't, a
word is a literal and the next place is tried. At a factor's end the windows that begin inside it and reach over the
boundary are looked up too, and the first that is known opens the next factor, so nothing that starts in one factor and
ends past it is missed. Factors (of ``window`` words at least) are the duplicate spans.

Blocks: parsing each document against each block would be quadratic, and a block can only hold a match if it holds the
window's words. So windows (seeds) are dealt to blocks by content, by the least hash of the ``anchor``-word runs in them
(the minimiser): equal windows meet in one block, no other block can hold them, and neighbouring windows mostly go to the
same one, as a run of eight bytes a word. A minimiser that very many windows share (of a line that is everywhere) would fill
one block: tasks report those they see often, and the windows of those that add up are dealt by their own hash instead.
Before that a task parses its own rows against each other, which settles copies inside the task: of a passage that is
everywhere each task sends the occurrences in one document, however many rows hold it.

Words are compared by hashes: a seed is a 64-bit fingerprint of a window and its minimiser, two neighbouring equal seeds
are one more equal word, and equal fingerprints are taken for equal windows.

Edge cases: null text has no words; texts shorter than a window lose nothing; a text that repeats itself loses nothing by
that; equal ids are one document to the rule and separate rows in the result, each with the spans of its own text; a null id
comes after all others; an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.bloom import marked_possible
from quarrystone.llm.common import pieces, release, small_batches, stored, table, text_blocks
from quarrystone.llm.words import U, Words, blob, mix, sliding_min, unblob

WINDOW, ANCHOR = 50, 8
_NULL_ID = np.iinfo(np.int64).max
#: Windows from which a task reports a minimiser, and from which reports make it hot; hot ones kept at most (others are
#: dealt out like the rest: the figure is one of balance, not of results).
SEEN, HOT, HOT_KEPT = 512, 50_000, 1 << 18


def _suffix_ranks(rank: np.ndarray, at: np.ndarray, stop: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Ranks of the seed sequences that begin at places ``at`` (and end before ``stop``), by prefix doubling; ``spot``: where
    in ``at`` a place is, or -1."""
    rank = np.unique(rank, return_inverse=True)[1]  # below len(at), as the pairs below need
    distinct, step = 0, 1
    while True:
        after = at + step
        inside = after < stop
        follow = np.where(inside, spot[np.where(inside, after, 0)], -1)
        pair = rank.astype(np.int64) * (len(at) + 1) + np.where(follow >= 0, rank[follow] + 1, 0)
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == distinct:
            return rank
        distinct, step = len(values), 2 * step


def _nearest_smaller(docs: list[int]) -> list[int]:
    """For each entry the nearest one before with a smaller document, or -1."""
    out, open_ = [], []
    for i, doc in enumerate(docs):
        while open_ and docs[open_[-1]] >= doc:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


class Block:
    """A reference block: runs of seeds, ordered by document and place, and their index."""

    def __init__(self, docs: np.ndarray, rows: np.ndarray, places: np.ndarray, lengths: np.ndarray, seeds: np.ndarray):
        order = np.lexsort((places, rows, docs))
        begin = np.cumsum(lengths) - lengths
        self.docs, self.rows, self.places = docs[order], rows[order], places[order].astype(np.int64)
        n = lengths[order].astype(np.int64)
        self.first = np.cumsum(n) - n
        self.run = np.repeat(np.arange(len(n)), n)
        self.seeds = seeds[np.arange(int(n.sum())) + np.repeat(begin[order] - self.first, n)]
        self.stop = self.first + n
        _, head, self.rank, self.count = np.unique(self.seeds, return_index=True, return_inverse=True, return_counts=True)
        # places stand in document order, so a seed's first place is in the smallest document that has it
        self.known = self.docs[self.run[head[self.rank]]] < self.docs[self.run]

    def _matched(self, p: int, q: int) -> int:
        """How many seeds from places p and q on are alike."""
        most = int(min(self.stop[self.run[p]] - p, self.stop[self.run[q]] - q))
        done, step = 0, 16
        while done < most:
            end = min(most, done + step)
            differ = np.flatnonzero(self.seeds[p + done : p + end] != self.seeds[q + done : q + end])
            if len(differ):
                return done + int(differ[0])
            done, step = end, 4 * step
        return most

    def factors(self, window: int) -> dict[str, np.ndarray]:
        """The greedy factors of all runs: doc, row, start, length, source_doc, source_start."""
        known = np.flatnonzero(self.known).tolist()
        found: list[tuple[int, int, int]] = []
        if known:
            at = np.flatnonzero(self.count[self.rank] > 1)
            spot = np.full(len(self.seeds), -1, np.int64)
            spot[at] = np.arange(len(at))
            order = np.argsort(_suffix_ranks(self.rank[at], at, self.stop[self.run[at]], spot), kind="stable")
            sorted_docs = self.docs[self.run[at[order]]].tolist()
            before = _nearest_smaller(sorted_docs)
            after = [len(order) - 1 - x if x >= 0 else -1 for x in reversed(_nearest_smaller(sorted_docs[::-1]))]
            where = np.empty(len(order), np.int64)
            where[order] = np.arange(len(order))
            i = 0
            while i < len(known):
                p = known[i]
                mine = int(where[spot[p]])
                source, length = max(((q, self._matched(p, q)) for x in (before[mine], after[mine]) if x >= 0 for q in (int(at[order[x]]),)), key=lambda f: f[1])
                found.append((p, source, length))
                i = bisect_left(known, p + length, i + 1)
        p, q, n = np.array(found, np.int64).reshape(-1, 3).T
        a, b = self.run[p], self.run[q]
        return {
            "doc": self.docs[a], "row": self.rows[a], "start": self.places[a] + p - self.first[a], "length": n + window - 1,
            "source_doc": self.docs[b], "source_start": self.places[b] + q - self.first[b],
        }


SPANS = ["doc", "row", "start", "length", "source_doc", "source_start"]


def _span_rows(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=SPANS)


class Seeds:
    """The windows of a batch's texts, row after row: fingerprint, minimiser, row and place of each."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        w = Words(texts)
        h = w.hashes()
        inside = np.flatnonzero(w.inside(window))
        self.least = sliding_min(w.run_hashes(h, anchor), window - anchor + 1)[inside]
        self.seeds = mix(w.run_hashes(h, window)[inside] ^ self.least)
        self.row = w.row_of_words()[inside]
        self.places = (inside - w.off[self.row]).astype(np.int32)


def hot_minimisers(rows: DataFrame, window: int, anchor: int) -> np.ndarray:
    """The minimisers that very many windows share, sorted."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in pieces(batches, "text", 2 << 20):
            values, counts = np.unique(Seeds(batch.column(2), window, anchor).least, return_counts=True)
            often = counts > window
            for value, count in zip(values[often].tolist(), counts[often].tolist()):
                seen[value] = seen.get(value, 0) + count
            if len(seen) > 200_000:
                seen = {v: c for v, c in seen.items() if c >= SEEN}
        seen = {v: c for v, c in seen.items() if c >= SEEN}
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(seen), U).astype(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["least", "hits"])

    found = rows.mapInArrow(run, "least long, hits long").groupBy("least").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= HOT)
    return np.sort(np.array([r["least"] for r in found.orderBy(F.desc("hits"), "least").limit(HOT_KEPT).collect()], np.int64).astype(U))


def send_seeds(rows: DataFrame, blocks: int, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """Per task: rows of (block, runs) to be parsed in their block, and rows of (block, spans) parsed here already."""

    def run(batches):
        for batch in pieces(batches, "text", 2 << 20):
            ids, raw = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            s = Seeds(batch.column(2), window, anchor)
            if not len(s.seeds):
                continue
            held, first, n = np.unique(s.row, return_index=True, return_counts=True)
            here = Block(ids[held], raw[held], np.zeros(len(held), np.int64), n, s.seeds)
            if here.known.any():
                yield _sent(int(ids[held[0]] % blocks), None, blob(*here.factors(window).values()))
            # back from the block's order to the batch's; a document that repeats itself sends each occurrence
            order = np.lexsort((raw[held], ids[held]))
            spots = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in order])
            own = np.sort(spots[~here.known])
            if not len(own):
                continue
            seeds, least, row, places = s.seeds[own], s.least[own], s.row[own], s.places[own]
            del here, spots
            if len(hot):
                least = np.where(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least, seeds, least)
            block = (mix(least) % U(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            seeds, row, places, block = seeds[order], row[order], places[order], block[order]
            opens = np.ones(len(seeds), bool)
            opens[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1]) | (places[1:] != places[:-1] + 1)
            runs = np.flatnonzero(opens)
            length = np.diff(np.append(runs, len(seeds))).astype(np.int32)
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            low_run = np.searchsorted(runs, cut)
            for i, low in enumerate(cut.tolist()):
                high = int(cut[i + 1]) if i + 1 < len(cut) else len(seeds)
                a, b = int(low_run[i]), int(low_run[i + 1]) if i + 1 < len(cut) else len(runs)
                of = row[runs[a:b]]
                yield _sent(int(block[low]), blob(ids[of], raw[of], places[runs[a:b]], length[a:b], seeds[low:high]), None)

    return rows.mapInArrow(run, "block int, runs binary, spans binary")


def _sent(block: int, runs: bytes | None, spans: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([runs], pa.binary()), pa.array([spans], pa.binary())], names=["block", "runs", "spans"])


def parse_blocks(sent: DataFrame, blocks: int, window: int) -> DataFrame:
    """Each block's runs parsed against the block; spans that came parsed pass through."""

    def run(batches):
        release()
        held = []
        for batch in batches:
            for runs, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans is not None:
                    yield _span_rows(unblob(spans))
                if runs is not None:
                    held.append(unblob(runs))
        if held:
            parts = []
            for i in range(5):
                parts.append(np.concatenate([h[i] for h in held]))
                for h in held:
                    h[i] = None
            block = Block(*parts)
            del parts, held
            if block.known.any():
                yield _span_rows(list(block.factors(window).values()))
            release()

    return sent.repartition(blocks, "block").mapInArrow(run, ", ".join(f"{n} long" for n in SPANS))


def _known_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, row, text): the id, null as the largest, and a hash of the text."""
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def duplicate_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Factors: (doc, row, start, length, source_doc, source_start), in words; those of one document may overlap. ``row`` is a
    hash of the text and tells rows of one id apart."""
    small_batches(docs.sparkSession)
    blocks = text_blocks(docs, text, 4)
    rows = _known_rows(docs, id, text)
    return parse_blocks(send_seeds(rows, blocks, window, anchor, hot_minimisers(rows, window, anchor)), blocks, window)


def remove_spans(docs: DataFrame, spans: DataFrame, id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row (and kept_text): its words outside the spans, joined by one space.
    Only rows that a filter of the spans' rows may hold shuffle to meet their spans."""
    key = F.xxhash64("doc", "row").alias("key")
    spans = stored(spans.select(key, "start", "length"), "spans")
    per = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list(F.col("start") + F.col("length")).alias("ends"))
    marked = marked_possible(_known_rows(docs, id, text).select(key, "doc", "text"), "key", spans)
    with_spans = marked.where("_x_again").join(per.hint("shuffle_hash"), "key", "left").select("doc", "text", "starts", "ends")
    none = F.lit(None).cast("array<long>")
    joined = marked.where("not _x_again").select("doc", "text", none.alias("starts"), none.alias("ends")).unionByName(with_spans)
    fields = f"{id} long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def run(batches):
        for batch in pieces(batches, "text"):
            w = Words(batch.column(1))
            step = np.zeros(len(w) + 1, np.int64)
            for column, sign in ((batch.column(2), 1), (batch.column(3), -1)):
                held = column.cast(pa.large_list(pa.int64()))
                n = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(step, np.repeat(w.off[:-1], n) + held.flatten().to_numpy(zero_copy_only=False), sign)
            keep = np.cumsum(step[:-1]) == 0
            out, at = w.joined(keep)
            held, cut = out.tobytes(), at.tolist()
            removed = np.bincount(w.row_of_words()[~keep], minlength=w.rows)
            digests = [hashlib.sha256(held[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])]
            columns = [batch.column(0), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
            if keep_text:
                columns.append(pa.array([held[a:b].decode() for a, b in zip(cut[:-1], cut[1:])]))
            yield pa.RecordBatch.from_arrays(columns, names=[id, "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    return joined.mapInArrow(run, fields).withColumn(id, F.nullif(F.col(id), F.lit(_NULL_ID)))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return remove_spans(docs, duplicate_spans(docs), keep_text=False)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
k AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS seed FROM s),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seed) < doc_id AS known FROM k),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE known) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, j: gone IS NULL OR NOT list_contains(gone, j)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
