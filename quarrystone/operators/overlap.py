"""How much the two sides of given pairs have in common, counted on bits of blocks of items.

Items are dealt to blocks by a hash, and each pair goes to the cell of its sides' blocks, where both blocks are once. There, what
an item has is a row of bits, and a pair costs an AND of two rows. So no pair carries the lists of its sides: what shuffles is each
pair once and each block once for each block it meets.

Edge cases: null items and groups take no part; a group that an item repeats counts once; pairs with a side that has nothing, or
is null, have 0 in common and stay; repeated pairs stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Items of a block; groups that are made bits of at once; words of the rows of bits that are compared at once.
BLOCK, GROUPS, WORDS = 4096, 1 << 15, 1 << 20


def _common(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common bits of rows i and j of ``bits`` (words of 64)."""
    out, step = np.zeros(len(i), np.int64), max(1, WORDS // max(1, bits.shape[1]))
    for low in range(0, len(i), step):
        out[low : low + step] = np.bitwise_count(bits[i[low : low + step]] & bits[j[low : low + step]]).sum(1, dtype=np.int64)
    return out


def _cells(pairs: DataFrame, a: str, b: str, held: DataFrame, blocks: int, cell, extra: list[str]) -> DataFrame:
    """``cell`` for each pair of blocks, on its pairs and what is ``held`` (item, block, ...) of either; adds ``extra`` columns."""
    one, two = (F.coalesce(F.pmod(F.xxhash64(c), F.lit(blocks)), F.lit(0)).cast("int") for c in (a, b))
    asked = pairs.withColumn("_first", F.least(one, two)).withColumn("_second", F.greatest(one, two))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    met = held.select("*", other).withColumn("_first", F.least("block", "_other")).withColumn("_second", F.greatest("block", "_other")).drop("_other")
    schema = StructType(list(pairs.schema.fields))
    for c in extra:
        schema = schema.add(c, LongType())

    def run(asked: pa.Table, met: pa.Table) -> pa.Table:
        kept = asked.select(pairs_columns)
        for c, values in zip(extra, cell(asked.column(a), asked.column(b), met)):
            kept = kept.append_column(c, pa.array(values, pa.int64()))
        return kept

    pairs_columns = pairs.columns
    return asked.groupBy("_first", "_second").cogroup(met.groupBy("_first", "_second")).applyInArrow(run, schema)


def _places(column, items) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is among ``items``, and whether it is."""
    at = pc.index_in(column, value_set=items)
    at = at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at
    return at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), at.is_valid().to_numpy(zero_copy_only=False)


def _pack(block: pd.DataFrame) -> pd.DataFrame:
    row, items = pd.factorize(block["item"], sort=True)
    return pd.DataFrame({"block": [block["block"].iloc[0]], "items": [list(items)], "row": [row.astype(np.int32)], "term": [block["term"].to_numpy()]})


def shared_groups(pairs: DataFrame, a: str, b: str, rows: DataFrame, item: str, group: str, block: int = BLOCK) -> DataFrame:
    """``pairs`` with ``shared``: how many groups of ``rows`` the items (texts) in columns ``a`` and ``b`` have in common."""
    held = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.xxhash64(group).alias("term")).distinct()
    blocks = max(1, -(-held.select("item").distinct().count() // block))
    held = held.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    packed = held.groupBy("block").applyInPandas(_pack, "block int, items array<string>, row array<int>, term array<long>")

    def cell(x, y, met: pa.Table) -> list[np.ndarray]:
        n = np.zeros(len(x), np.int64)
        if not len(x) or not met.num_rows:
            return [n]
        lists = [met.column("items")[k].values for k in range(met.num_rows)]
        start = np.cumsum([0] + [len(v) for v in lists])
        row = np.concatenate([met.column("row")[k].values.to_numpy() + start[k] for k in range(met.num_rows)])
        term = np.concatenate([met.column("term")[k].values.to_numpy() for k in range(met.num_rows)])
        (i, known), (j, met_too) = (_places(c, pa.concat_arrays(lists)) for c in (x, y))
        ask = np.flatnonzero(known & met_too)
        known_terms, term = np.unique(term, return_inverse=True)
        order = np.argsort(term, kind="stable")
        row, term = row[order], term[order]
        for low in range(0, len(known_terms), GROUPS):
            here = slice(*np.searchsorted(term, [low, low + GROUPS]))
            bits = np.zeros((start[-1], -(-min(GROUPS, len(known_terms) - low) // 64)), np.uint64)
            at = term[here] - low
            np.bitwise_or.at(bits, (row[here], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
            n[ask] += _common(bits, i[ask], j[ask])
        return [n]

    return _cells(pairs, a, b, packed, blocks, cell, ["shared"])


def shared_neighbours(pairs: DataFrame, a: str, b: str, bits: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pairs`` with ``common``, ``one`` and ``two``: the neighbours that both sides have, and those of each. ``bits``: (item, part,
    bits) of ``together.neighbour_bits``, stored, as it is read twice."""
    blocks = max(1, -(-bits.select("item").distinct().count() // block))
    held = bits.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))

    def cell(x, y, met: pa.Table) -> list[np.ndarray]:
        common, one, two = (np.zeros(len(x), np.int64) for _ in range(3))
        if not len(x) or not met.num_rows:
            return [common, one, two]
        items = pc.unique(met.column("item"))
        (i, known), (j, met_too) = (_places(c, items) for c in (x, y))
        place, _ = _places(met.column("item"), items)
        part = met.column("part").to_numpy()
        ask, size = np.flatnonzero(known & met_too), np.zeros(len(items), np.int64)
        for p in np.unique(part):
            here = np.flatnonzero(part == p)
            rows = np.frombuffer(b"".join(met.column("bits").take(pa.array(here)).to_pylist()), np.uint64).reshape(len(here), -1)
            table = np.zeros((len(items), rows.shape[1]), np.uint64)
            table[place[here]] = rows
            size += np.bitwise_count(table).sum(1, dtype=np.int64)
            common[ask] += _common(table, i[ask], j[ask])
        one[known], two[met_too] = size[i[known]], size[j[met_too]]
        return [common, one, two]

    return _cells(pairs, a, b, held, blocks, cell, ["common", "one", "two"])
