"""Fuzzy string functions without a built-in equivalent, over Arrow batches; and some that need none."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no substring edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a row each, padded; and their lengths."""
    n = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(n.max(initial=0))), -1, np.int32)
    out[np.arange(out.shape[1])[None] < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, n


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between the strings of each pair."""
    return _distances(a, b, False)


def osa_distances(a: list[str], b: list[str]) -> np.ndarray:
    """``osa_distance`` of each pair."""
    return _distances(a, b, True)


def _distances(a: list[str], b: list[str], swaps: bool) -> np.ndarray:
    """One table for all pairs, filled cell by cell across the batch."""
    x, n = _codes(a)
    y, m = _codes(b)
    rows = [np.tile(np.arange(y.shape[1] + 1), (len(a), 1))]
    out = np.where(n == 0, m, 0)
    for i in range(1, x.shape[1] + 1):
        row = np.empty_like(rows[-1])
        row[:, 0] = i
        for j in range(1, y.shape[1] + 1):
            best = np.minimum(np.minimum(rows[-1][:, j], row[:, j - 1]) + 1, rows[-1][:, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if swaps and i > 1 and j > 1:
                swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swapped, np.minimum(best, rows[-2][:, j - 2] + 1), best)
            row[:, j] = best
        rows = [rows[-1], row]
        out = np.where(n == i, np.take_along_axis(row, m[:, None], axis=1)[:, 0], out)
    return out


@F.pandas_udf(T.LongType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(a), dtype="Int64")
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    for low in range(0, len(known), 4096):
        pick = known[low : low + 4096]
        out.iloc[pick] = osa_distances(a.iloc[pick].tolist(), b.iloc[pick].tolist())
    return out


_POSITIONS = T.ArrayType(
    T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType()), T.StructField("number", T.LongType())])
)
_WORD = re.compile(r"\b[a-zA-Z]+\b")


@F.pandas_udf(_POSITIONS)
def token_positions(text: pd.Series) -> pd.Series:
    """Words of two letters or more with their places, up to 50 characters on either side, line ends as spaces, and the number of
    that word's occurrence in the text, from 1."""

    def one(t: str | None) -> list:
        if t is None:
            return []
        flat, seen, out = t.replace("\n", " "), Counter(), []
        for m in _WORD.finditer(t):
            if m.end() - m.start() > 1:
                word = m[0].lower()
                seen[word] += 1
                out.append({"word": word, "start": m.start(), "end": m.end(), "before": flat[max(0, m.start() - 50) : m.start()].strip(), "after": flat[m.end() : m.end() + 50].strip(), "number": seen[word]})
        return out

    return text.map(one)


def extended_hamming(a: Column, b: Column) -> Column:
    """Mismatches over the common length, and the difference in length; no UDF."""
    both = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    wrong = F.size(F.filter(both, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter == 0, F.greatest(F.length(a), F.length(b))).otherwise(wrong + F.abs(F.length(a) - F.length(b)))
