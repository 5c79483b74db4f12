"""Pairs of items by the groups they share, counted by products of blocks of items.

Items are dealt to blocks by a hash; a block is packed once, as the groups of each of its items. Each pair of blocks is one task's
product (``cosine.products``), so a pair that meets in many groups is one number of a matrix, and never a row until it is a
result: what shuffles is each block, once for each block it meets, and grows with items times groups, not with pairs.

Edge cases: null items and groups take no part; an item that stands in a group several times counts as often, as in a join;
items that share too little have no rows; an empty table gives an empty result. Groups are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.cosine import products

BLOCK, BATCH = 2048, 1 << 16


def _pack(block: pd.DataFrame) -> pd.DataFrame:
    row, items = pd.factorize(block["item"], sort=True)
    order = np.argsort(block["term"].to_numpy(), kind="stable")
    sides = {"items": [list(items)], "row": [row[order].astype(np.int32)], "term": [block["term"].to_numpy()[order]], "w": [block["w"].to_numpy()[order]]}
    return pd.DataFrame({"block": [block["block"].iloc[0]]} | sides)


def _met(rows: DataFrame, group: str, item: str, block: int) -> DataFrame:
    """The packed blocks of items, each once for every block that it meets, as (first, second, ...)."""
    held = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(item).alias("item"), F.xxhash64(group).alias("term")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    blocks = max(1, -(-rows.select(item).distinct().count() // block))
    held = held.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    packed = held.groupBy("block").applyInPandas(_pack, f"block int, items array<{dict(rows.dtypes)[item]}>, row array<int>, term array<long>, w array<double>")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    return packed.select("*", other).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")


def _counted(pair: pa.Table):
    """(one, two, n, alone) of a cell: its sides, how often each item of one meets each of two, and whether they are the same;
    none where a block of the cell has no items."""
    sides = sorted(_sides(pair), key=lambda s: s[0])
    alone = pair.column("first")[0] == pair.column("second")[0]
    if alone or len(sides) == 2:
        yield sides[0], sides[-1], products(sides[0][2], sides[-1][2]), alone


def shared_counts(rows: DataFrame, group: str, item: str, least: int, block: int = BLOCK) -> DataFrame:
    """(a, b, n): the pairs a < b of items (texts or whole numbers) in ``rows`` that meet ``least`` times or more in a group."""
    kind = dict(rows.dtypes)[item]
    arrow = pa.string() if kind == "string" else pa.int64()

    def cell(pair: pa.Table) -> pa.Table:
        made = []
        for (_, one, _), (_, two, _), n, alone in _counted(pair):
            i, j = np.nonzero(n >= least)
            if alone:
                i, j = i[i < j], j[i < j]
            for low in range(0, len(i), BATCH):
                p, q = i[low : low + BATCH], j[low : low + BATCH]
                a, b = one.take(pa.array(p)), two.take(pa.array(q))
                swap = pc.greater(a, b)
                made.append(pa.record_batch([pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(n[p, q].astype(np.int64))], names=["a", "b", "n"]))
        return pa.Table.from_batches(made, pa.schema([("a", arrow), ("b", arrow), ("n", pa.int64())]))

    return _met(rows, group, item, block).groupBy("first", "second").applyInArrow(cell, f"a {kind}, b {kind}, n long")


def shared_total(rows: DataFrame, group: str, item: str, least: int, block: int = BLOCK) -> DataFrame:
    """(n): how many pairs ``shared_counts`` gives, counted where they meet."""

    def cell(pair: pa.Table) -> pa.Table:
        found = [int(np.count_nonzero(np.triu(n >= least, 1) if alone else n >= least)) for _, _, n, alone in _counted(pair)]
        return pa.table({"n": pa.array(found, pa.int64())})

    return _met(rows, group, item, block).groupBy("first", "second").applyInArrow(cell, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def neighbour_bits(rows: DataFrame, group: str, item: str, least: int, block: int = BLOCK) -> DataFrame:
    """(item, part, bits): for each item the others that it meets ``least`` times or more, as bits over the items of block
    ``part``; blocks without any have no row. Bits of a part are of one length, a multiple of 64."""

    def cell(pair: pa.Table) -> pa.Table:
        made = []
        for (first, one, _), (second, two, _), n, alone in _counted(pair):
            near = n >= least
            if alone:
                np.fill_diagonal(near, False)
            for items, part, side in ((one, second, near),) if alone else ((one, second, near), (two, first, near.T)):
                some = np.flatnonzero(side.any(1))
                wide = np.zeros((len(some), -(-side.shape[1] // 64) * 64), bool)
                wide[:, : side.shape[1]] = side[some]
                bits = [r.tobytes() for r in np.packbits(wide, axis=1)]
                made.append(pa.record_batch([items.take(pa.array(some)), pa.array(np.full(len(some), part, np.int32)), pa.array(bits, pa.binary())], names=["item", "part", "bits"]))
        return pa.Table.from_batches(made, pa.schema([("item", pa.string()), ("part", pa.int32()), ("bits", pa.binary())]))

    return _met(rows, group, item, block).groupBy("first", "second").applyInArrow(cell, "item string, part int, bits binary")


def _sides(pair: pa.Table) -> list[tuple]:
    """Each block of a pair: its number, its items in order, and its arrays as ``products`` takes them."""
    out = []
    for k in range(pair.num_rows):
        items = pair.column("items")[k].values
        row, term, w = (pair.column(c)[k].values.to_numpy() for c in ("row", "term", "w"))
        out.append((pair.column("block")[k].as_py(), items, (len(items), row, term, w)))
    return out
