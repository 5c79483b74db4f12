"""Packing token ids into sequences: first-fit decreasing, bins found in a tournament tree, in randomised groups.

Each text is encoded whole, ended by one id, and cut every ``capacity`` ids; the cuts are dealt at random, by their
place in the input, into groups of about 4,096 on average, whatever their texts or ids, so no group grows with the
input or with a source. Groups are packed apart: longest cuts first, each into the first bin with room, which the tree
of largest free spaces finds in log(bins) steps. A group wastes part of its last bins only.

Edge cases: null text is empty and holds only the end id; a text of any length is cut, never shortened; equal rows and
equal or null ids are packed row by row; equal lengths are taken by id, then start; an empty table has no sequences.
Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, small_batches, table
from quarrystone.llm.tokens import batch_tokenizer
from quarrystone.llm.words import U, mix

CAPACITY, GROUP = 2048, 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def first_fit_decreasing(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. The tree's leaves are bins' free spaces, its inner nodes the larger of two."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lengths = [int(x) for x in lengths]
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        size, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def cut_tokens(docs: DataFrame, id: str, text: str, groups: int, tokenizer: str, end: int, capacity: int, keep_ids: bool) -> DataFrame:
    """One row a cut: id, start, length, ids_crc32, doc_tokens, group (and ids)."""
    small_batches(docs.sparkSession)
    fields = [("doc", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("group", "long")]
    fields += [("ids", "array<int>")] * keep_ids

    def run(batches):
        encode = batch_tokenizer(tokenizer, end, keep_space=False).encode
        part, done = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text"):
            ids, at = encode(batch.column(1))
            n = np.diff(at)
            cuts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), cuts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = nth * capacity
            length = np.minimum(capacity, n[row] - start)
            low = (at[row] + start).tolist()
            held = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(held[a : a + k]) for a, k in zip(low, length.tolist())]
            place = (np.arange(done, done + len(row), dtype=U) + (U(part) << U(40))) * U(0x9E3779B97F4A7C15)
            done += len(row)
            columns = [batch.column(0).take(pa.array(row)), start, length, crc, n[row], (mix(place) % U(groups)).astype(np.int64)]
            columns = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns]
            if keep_ids:
                columns.append(pa.array([held[a : a + k].astype(np.int32) for a, k in zip(low, length.tolist())], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f for f, _ in fields])

    return docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{a} {b}" for a, b in fields))


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 1, capacity: int = CAPACITY, group: int = GROUP, keep_ids: bool = True) -> DataFrame:
    """One row a cut, with its sequence_id and offset there; ``keep_ids`` adds the ids themselves."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    groups = max(1, -(-(int(row["n"]) + int(row["b"] or 0) // (4 * capacity)) // group))
    cut = cut_tokens(docs, id, text, groups, tokenizer or default_tokenizer(), end, capacity, keep_ids)
    held = ", ids array<int>" * keep_ids
    schema = f"{id} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{held}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        out = pd.DataFrame({id: rows["doc"].astype("Int64")} | {c: rows[c] for c in ("start", "length", "ids_crc32", "doc_tokens")})
        out["sequence_id"] = rows["group"].to_numpy() * (1 << 31) + bins
        out["offset"] = offsets
        return out.assign(ids=rows["ids"]) if keep_ids else out

    return cut.groupBy("group").applyInPandas(run, schema)


def op4_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
