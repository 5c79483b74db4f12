"""The first sentences of a document that say something, past mail headers and page furniture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cleaned out first, and the lines that are skipped until the first line of content.
CLEANED = [
    (r"(?m)^\s*\d+\s*$", ""),
    (r"DOC\d+", ""),  # the corpus's own prefix
    (r"\n{2,}", "\n"),
    (r"(?m)^\s*[-_=*]+\s*$", ""),
    (r"(?mi)^\s*Page\s+\d+.*$", ""),
    (r"(?m)^\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\s*$", ""),
]
SKIPPED = [
    r"^(from|to|cc|bcc|subject|date|sent|received):\s*",
    r"\b(from|to|cc|bcc|subject|date|sent):\s*",
    r"^(re|fw|fwd):\s*",
    r"\bsubject:\s*(re|fw|fwd)?:?\s*",
    r"@[a-zA-Z0-9.-]+\.(com|org|net|edu|gov|co\.\w+)",
    r"[®@][a-zA-Z]+\.(com|org|net)",
    r"\([^)]*[@®][^)]*\)",
    r"<[^>]*>",
    r"^(monday|tuesday|wednesday|thursday|friday|saturday|sunday),?\s*\d",
    r"^\d{1,2}:\d{2}\s*(am|pm)?",
    r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d",
    r"^\s*\d+\s*$",
    r"^[-_=*\s]+$",
    r"^(confidential|privileged|attorney.client)",
    r"^(sent from|get outlook|inline-images)",
    r"^\s*\[.*\]\s*$",
    r"^(attachment|enclosed|please see attached)",
    r"^dear\s+",
    r"^(sincerely|regards|best|thanks),?\s*$",
    r"^\s*-{2,}\s*(original|forwarded)",
    r"^[A-Z]{2,}\s+[A-Z]\s+[A-Z]{2,}\s*$",
    r"^[A-Z][A-Z\s]{5,}$",
    r"'[A-Z][A-Z\s]+'|\"[A-Z][A-Z\s]+\"",
    r"us\s+v\.\s*$",
    r"^wrote:?\s*$",
    r"^on\s+\d+/\d+",
    r"\+\d{1,3}\s*\d{3}",
    r"\bP\.?C\.?\s*$",
    r"\bL\.?L\.?P\.?\s*$",
    r"\bEsq\.?\s*$",
    r"Partner\s*$",
    r"^\d+\s+(E\.|W\.|N\.|S\.)?\s*\d*(st|nd|rd|th)?\s*(Street|Avenue|Ave|St)",
]
SKIP = "(?i)(?:" + "|".join(f"(?:{p})" for p in SKIPPED) + ")"


def _says_something(line: Column) -> Column:
    words = F.filter(F.split(line, r"\s+"), lambda w: w.rlike("[a-zA-Z]{2,}"))
    return (F.length(line) >= 20) & (F.size(words) >= 4)


def opener(text: Column, most: int = 200) -> Column:
    """At most two sentences of the first five lines of content, cut to ``most``; else the text's own start. Null gives null.

    Matching ignores case, as the lists intend; a line of content ends the skipping for those after it."""
    clean = text
    for pattern, by in CLEANED:
        clean = F.regexp_replace(clean, pattern, by)
    lines = F.filter(F.transform(F.split(clean, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    usable = F.filter(lines, _says_something)
    # without the leading skipped lines: what is usable from the first usable line that no pattern holds
    first = F.array_position(F.transform(usable, lambda x: ~x.rlike(SKIP)), True)
    content = F.when(first > 0, F.slice(usable, F.greatest(first, F.lit(1)).cast("int"), 5)).otherwise(F.array().cast("array<string>"))
    sentences = F.transform(F.split(F.array_join(content, " "), r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    told = F.array_join(F.slice(F.filter(sentences, lambda s: (F.length(s) > 30) & s.rlike("[a-zA-Z]{3,}")), 1, 2), ". ")
    head = F.substring(told, 1, most)
    upto_space = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    cut = F.when(head.contains(" ") & (F.length(upto_space) > int(most * 0.7)), upto_space).otherwise(head)
    whole = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return F.when(told == "", whole).when(F.length(told) > most, F.concat(cut, F.lit("..."))).otherwise(F.concat(told, F.lit(".")))
