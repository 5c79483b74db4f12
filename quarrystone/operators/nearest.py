"""Exact nearest strings by normalised edit distance, without pairing all with all.

The likeness of two strings is 1 - d / L, d their edit distance and L the longer length. Strings with c characters in common
(with repeats) are at least L - c edits apart, so c / L bounds their likeness from above. ``c`` of all pairs of a cell is one
product of matrices of zeros and ones, in which the k-th occurrence of a character has a column of its own. The radius then
grows: pairs whose bound allows r edits are measured for r = 0, 1, 2 ..., as long as their bound reaches the best likeness that
their query has found. Nothing is measured twice, and nothing that could be nearest is left out.

Cells hold at most about ``BLOCK`` targets and ``BLOCK`` queries; every cell gives each of its queries one row, and the best
of these rows is the result. A target list of one block is copied to each group of queries, never to a whole executor's memory.

Edge cases: null strings and null targets take no part; two empty strings are alike (1); ties go to the target's smaller
label; equal queries are one; without targets there are no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.fuzzy import edit_distances

BLOCK, STRIP, PAIRS = 8192, 512, 1 << 17


def _bags(texts: list[list[str]], column: dict[tuple[str, int], int]) -> np.ndarray:
    """Occurrences of characters as zeros and ones, a column for each character's k-th; those without a column are left out."""
    out = np.zeros((len(texts), len(column)), np.float32)
    for i, t in enumerate(texts):
        for c in t:
            at = column.get(c)
            if at is not None:
                out[i, at] = 1
    return out


def _numbered(text: str) -> list[tuple[str, int]]:
    seen: dict[str, int] = {}
    out = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        out.append((c, seen[c]))
    return out


def best_of(queries: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each query's nearest target (the first of equals) and their likeness; ``targets`` is not empty."""
    marks = [_numbered(t) for t in targets]
    column = {c: i for i, c in enumerate(sorted({c for m in marks for c in m}))}
    bags, long = _bags(marks, column), np.array([len(t) for t in targets])
    place, like = np.zeros(len(queries), np.int64), np.full(len(queries), -1.0)
    for low in range(0, len(queries), STRIP):
        part = queries[low : low + STRIP]
        size = np.array([len(q) for q in part])
        longer = np.maximum(np.maximum(size[:, None], long[None]), 1)
        edits = np.maximum(size[:, None], long[None]) - (_bags([_numbered(q) for q in part], column) @ bags.T).astype(np.int64)
        bound = 1 - edits / longer
        best, at = np.full(len(part), -1.0), np.zeros(len(part), np.int64)
        for r in range(int(edits.max()) + 1):
            i, j = np.nonzero((edits == r) & (bound >= best[:, None]))
            for k in range(0, len(i), PAIRS):
                a, b = i[k : k + PAIRS], j[k : k + PAIRS]
                reach = bound[a, b] >= best[a]  # what the pairs before have found may have ruled some out
                a, b = a[reach], b[reach]
                if len(a):
                    found = 1 - edit_distances([part[x] for x in a], [targets[y] for y in b]) / longer[a, b]
                    order = np.lexsort((b, -found, a))
                    a, b, found = a[order], b[order], found[order]
                    first = np.append(True, a[1:] != a[:-1])
                    a, b, found = a[first], b[first], found[first]
                    better = (found > best[a]) | ((found == best[a]) & (b < at[a]))
                    best[a[better]], at[a[better]] = found[better], b[better]
        place[low : low + STRIP], like[low : low + STRIP] = at, best
    return place, like


def nearest(queries: DataFrame, targets: DataFrame, text: str, label: str, block: int = BLOCK) -> DataFrame:
    """(text, label, likeness): for each different ``text`` of the queries its nearest target's label. ``targets`` has both columns."""
    asked = queries.where(F.col(text).isNotNull()).select(F.col(text).alias("q")).distinct()
    held = targets.where(F.col(text).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.min(label).alias("label"))
    groups, blocks = (max(1, -(-df.count() // block)) for df in (asked, held))
    asked = asked.select("q", F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    held = held.select("t", "label", F.pmod(F.xxhash64("t"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def cell(ask: pd.DataFrame, hold: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(hold):
            return pd.DataFrame({"q": [], "label": [], "likeness": []}).astype({"q": str, "label": str, "likeness": float})
        hold = hold.sort_values("label", kind="stable")
        at, like = best_of(ask["q"].tolist(), hold["t"].tolist())
        return pd.DataFrame({"q": ask["q"].to_numpy(), "label": hold["label"].to_numpy()[at], "likeness": like})

    deal = ["b", "g"]
    found = asked.groupBy(*deal).cogroup(held.groupBy(*deal)).applyInPandas(cell, "q string, label string, likeness double")
    best = found.groupBy("q").agg(F.min(F.struct((-F.col("likeness")).alias("away"), "label")).alias("m"))
    return best.select(F.col("q").alias(text), F.col("m.label").alias(label), (-F.col("m.away")).alias("likeness"))
