"""All pairs of sparse rows whose cosine reaches a threshold, by products of blocks of rows.

Rows are dealt to blocks by a hash of their id; a block is packed once, as arrays ordered by term. The products of two blocks
are added up in a dense matrix of block by block, frequent terms all at once as a product of dense matrices, the others term by
term on the rows that hold them. So a term that most rows hold costs no more than a column, and no product of two rows is ever
a row of a shuffle. Blocks meet in cells of two groups of up to ``GROUP`` blocks: what shuffles is each block, once for each
group it meets, and a cell gives its pairs away block by block. Where only numbers of pairs are asked for (``link_counts``),
cells count them.

Edge cases: null ids, terms and weights take no part; a term that a row repeats counts with its sum; rows without a pair have
no rows; an empty table gives an empty result. Terms are known by 64-bit hashes, taken for equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

#: Rows of a block, blocks of a group, pairs of a batch; groups that there are at least, if there are as many blocks.
BLOCK, GROUP, BATCH, LEAST = 2048, 8, 1 << 16, 8
_PACKED = "block int, ids array<long>, row array<int>, term array<long>, w array<double>"
_LABELLED = f"{_PACKED}, label array<long>, times array<long>"


def _pack(block: pd.DataFrame) -> pd.DataFrame:
    ids, some, row = np.unique(block["id"].to_numpy(np.int64), return_index=True, return_inverse=True)
    order = np.argsort(block["term"].to_numpy(), kind="stable")
    labels = {c: [block[c].to_numpy(np.int64)[some]] for c in ("label", "times") if c in block}
    return pd.DataFrame({"block": [block["block"].iloc[0]], "ids": [ids], "row": [row[order].astype(np.int32)], "term": [block["term"].to_numpy()[order]], "w": [block["w"].to_numpy()[order]]} | labels)


def products(one: tuple, other: tuple) -> np.ndarray:
    """Products of all rows of two blocks, each (number of rows, row, term, w) ordered by term."""
    (n, row, term, w), (m, row2, term2, w2) = one, other
    out = np.zeros((n, m))
    shared = np.intersect1d(term, term2)
    low, high = np.searchsorted(term, shared), np.searchsorted(term, shared, "right")
    low2, high2 = np.searchsorted(term2, shared), np.searchsorted(term2, shared, "right")
    many = (high - low) * (high2 - low2) * 16 > n * m
    if many.any():
        a, b = np.zeros((n, int(many.sum()))), np.zeros((m, int(many.sum())))
        for k, (i, j, x, y) in enumerate(zip(low[many], high[many], low2[many], high2[many])):
            np.add.at(a[:, k], row[i:j], w[i:j])
            np.add.at(b[:, k], row2[x:y], w2[x:y])
        out += a @ b.T
    flat = out.reshape(-1)
    for i, j, x, y in zip(low[~many].tolist(), high[~many].tolist(), low2[~many].tolist(), high2[~many].tolist()):
        at = (row[i:j, None].astype(np.int64) * m + row2[None, x:y]).reshape(-1)
        flat[at] += (w[i:j, None] * w2[None, x:y]).reshape(-1)
    return out


def _groups(blocks: int) -> int:
    return -(-blocks // max(1, min(GROUP, blocks // LEAST)))


def _met(rows: DataFrame, count: int, block: int, labels: DataFrame | None = None) -> GroupedData:
    """The packed blocks of ``rows`` in cells of two groups, with what ``labels`` (id, label, times) has of their ids."""
    blocks = max(1, -(-count // block))
    groups = _groups(blocks)
    held = rows.where("id IS NOT NULL AND term IS NOT NULL AND w IS NOT NULL").groupBy("id", F.xxhash64("term").alias("term")).agg(F.sum("w").alias("w"))
    held = held if labels is None else held.join(labels, "id")
    held = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = held.groupBy("block").applyInPandas(_pack, _PACKED if labels is None else _LABELLED)
    group, other = F.pmod("block", F.lit(groups)), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
    return packed.select("*", group.alias("group"), other).groupBy(F.least("group", "other").alias("first"), F.greatest("group", "other").alias("second"))


def _products(batches: Iterator[pa.RecordBatch], digits: int):
    """Of a cell: (one, two, out, alone) of each pair of its blocks; a block as {column: array}, and whether both are the same."""
    sides = [{c: b.column(c)[k].values.to_numpy() for c in b.schema.names if pa.types.is_list(b.schema.field(c).type)} | {c: b.column(c)[k].as_py() for c in ("block", "group")} for b in batches for k in range(b.num_rows)]
    sides.sort(key=lambda s: (s["group"], s["block"]))
    apart = sides[0]["group"] != sides[-1]["group"]
    packed = [(len(s["ids"]), s["row"], s["term"], s["w"]) for s in sides]
    for i, one in enumerate(sides):
        for j in range(i, len(sides)):
            if not apart or one["group"] != sides[j]["group"]:
                yield one, sides[j], np.round(products(packed[i], packed[j]), digits), i == j


def similar_pairs(rows: DataFrame, count: int, least: float, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(u, v, w): the pairs u < v of ids in ``rows`` (id, term, w) whose rows' product, rounded, is ``least`` or more. ``count``:
    about how many ids there are."""

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, out, alone in _cell(key, batches, digits):
            i, j = np.nonzero(out >= least)
            a, b, w = one["ids"][i], two["ids"][j], out[i, j]
            if alone:
                a, b, w = (x[i < j] for x in (a, b, w))
            for low in range(0, len(a), BATCH):
                p, q = a[low : low + BATCH], b[low : low + BATCH]
                yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(w[low : low + BATCH])], names=["u", "v", "w"])

    return _met(rows, count, block).applyInArrow(cell, "u long, v long, w double")


def link_counts(rows: DataFrame, count: int, least: float, labels: DataFrame, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(label, internal, external): for each label that has any, how many pairs of ``similar_pairs`` are within it and how many lead
    out of it. ``labels``: (id, label, times); a pair counts as often as its ids' times multiplied, those without a label not."""

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for one, two, out, alone in _cell(key, batches, digits):
            near = out >= least
            if alone:
                np.fill_diagonal(near, False)
            same = near & (one["label"][:, None] == two["label"][None, :])
            for side, other, m, s in ((one, two, near, same),) if alone else ((one, two, near, same), (two, one, near.T, same.T)):
                each, inside = (x @ other["times"] * side["times"] for x in (m, s))
                known, at = np.unique(side["label"], return_inverse=True)
                sums = np.zeros((len(known), 2), np.int64)
                np.add.at(sums, at, np.stack([inside, each - inside], axis=1))
                for label, n in zip(known.tolist(), sums):
                    if n.any():
                        found[label] = found.get(label, 0) + n
        if found:
            sums = np.array(list(found.values()))
            yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["label", "twice", "external"])

    counted = _met(rows, count, block, labels).applyInArrow(cell, "label long, twice long, external long")
    return counted.groupBy("label").agg(F.expr("sum(twice) div 2").alias("internal"), F.sum("external").alias("external"))


def _cell(key: tuple, batches: Iterator[pa.RecordBatch], digits: int):
    """The products of a cell; none of one whose other group has no rows."""
    held = list(batches)
    groups = {g for b in held for g in b.column("group").to_pylist()}
    if len(groups) == len({k.as_py() for k in key}):
        yield from _products(iter(held), digits)
