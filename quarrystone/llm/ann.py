"""Approximate nearest neighbours by collision counting over single projections (query-aware hashing).

Vectors, scaled to unit length, are projected on ``m`` random lines; each projection is a sorted array. A query opens a
window of half-width h around its own projection in every array and counts how often each vector falls in: collisions.
Virtual rehashing widens all windows by a factor, counting only what the wider windows add. A vector whose collisions
reach half the lines is verified: its exact cosine, in double precision on the original components. A query stops once a
vector as near as its k-th best would, with the probability given by ``certainty``, have been verified already, or once
all are. The stop rule uses only distances found, so windows fit the data, and no count of candidates is capped.

Scale: vectors lie in blocks of about 8,192. A task gets one block, builds its arrays once, and then reads the queries one
after the other, as a stream; each query's k best of every block are merged. Past 65,536 queries they come in groups, a task
for each block and group, where building the arrays is a small part of the work. That is a stated query set against all rows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, and such queries
have no rows; vectors of another dimension than the query's are no candidates; rows with the query's own id are not
candidates, so of a repeated id no row is one for another; queries of one id are one query, as near to a row as the nearest
of them; rows of one id come once, with their best score; equal vectors score equal and come by smaller id; fewer than k
candidates: all; a null id takes no part; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import stored, table

LINES, BLOCK, QUERIES, WIDEN, CERTAINTY = 64, 8192, 65536, 1.12, 1.2


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec, x) of the rows that take part, as doubles."""
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = df.select(F.col(id).cast("long").alias("vec"), F.col(vector).cast("array<double>").alias("x"))
    return rows.where(F.col("vec").isNotNull() & F.col("x").isNotNull() & F.coalesce(good, F.lit(False)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, exactly, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Arrays:
    """One block's index: its unit vectors' projections, sorted line by line in one flat array."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: int = LINES):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], _scaled(x[order])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        rng = np.random.default_rng(x.shape[1])
        self.lines = rng.normal(size=(x.shape[1], lines))
        unit = self.x / self.norm[:, None]
        self.near = unit.astype(np.float32)
        p = (unit @ self.lines).T
        self.order = np.argsort(p, axis=1, kind="stable")
        self.gap = 4 * float(np.abs(p).max()) + 64
        self.base = np.arange(lines) * self.gap
        self.keys = (np.take_along_axis(p, self.order, axis=1) + self.base[:, None]).reshape(-1)
        self.order = self.order.reshape(-1)

    def _hits(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[a:b] for a, b in zip(low.tolist(), high.tolist())])

    def search(self, query_id: int, q: np.ndarray, k: int, certainty: float = CERTAINTY) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and cosines of the k best found, and how many vectors were verified."""
        n, lines = len(self.ids), self.lines.shape[1]
        q = _scaled(q[None])[0]
        norm = math.sqrt(float((q * q).sum()))
        at = (q / norm) @ self.lines + self.base
        need = lines // 2
        counts = np.zeros(n, np.int64)
        fresh = self.ids != query_id
        left = int(fresh.sum())
        found, cos, verified = np.zeros(0, np.int64), np.zeros(0), 0
        unit = (q / norm).astype(np.float32)
        h, low, high = 0.25, None, None
        edges = self.base - self.gap / 2, self.base + self.gap / 2
        while left:
            a = np.searchsorted(self.keys, np.maximum(at - h, edges[0]))
            b = np.searchsorted(self.keys, np.minimum(at + h, edges[1]), "right")
            if low is None:
                hits = self._hits(a, b)
            else:
                hits = self._hits(np.concatenate([a, high]), np.concatenate([low, b]))
            counts += np.bincount(hits, minlength=n)
            low, high = a, b
            new = np.flatnonzero(fresh & (counts >= need))
            if len(new):
                fresh[new] = False
                left -= len(new)
                verified += len(new)
                if len(found) == k:  # single precision rules out what can't come among the k best
                    new = new[self.near[new] @ unit >= cos[-1] - 1e-4]
                c = (self.x[new] * q).sum(axis=1) / (self.norm[new] * norm)
                found, cos = np.concatenate([found, new]), np.concatenate([cos, c])
                best = np.lexsort((found, -cos))[:k]
                found, cos = found[best], cos[best]
            if len(found) == k:
                away = math.sqrt(max(0.0, 2 - 2 * float(cos[-1])))
                p = math.erf(h / (away * math.sqrt(2))) if away > 0 else 1.0
                if lines * p - certainty * math.sqrt(lines * p * (1 - p)) >= need:
                    break
            h *= WIDEN
        return found, cos, verified


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest rows of ``vectors``."""
    rows, asked = stored(usable(vectors, id, vector), "ann-vectors"), stored(usable(queries, id, vector), "ann-queries")
    blocks, groups = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // QUERIES))
    block, group = F.pmod(F.xxhash64("vec"), F.lit(blocks)), F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(groups))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    homes = rows.select("vec", "x", block.alias("block"), every(groups).alias("group"), F.lit(False).alias("asked"))
    guests = asked.select("vec", "x", every(blocks).alias("block"), group.alias("group"), F.lit(True).alias("asked"))
    cell = (F.col("block") * groups + F.col("group")).cast("int").alias("cell")
    dealt = homes.unionByName(guests).select("vec", "x", "asked", cell, F.size("x").alias("dim"))

    def run(batches):
        """Rows come by cell and dimension, vectors before queries."""
        of, index, data = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asks, cells, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(dims) - dims
            kind = np.stack([cells, dims, asks.astype(dims.dtype)], axis=1)
            cut = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]).any(axis=1)))
            for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
                x = flat[at[low] : at[high - 1] + dims[low]].reshape(high - low, dims[low])
                if of != (cells[low], dims[low]):
                    of, index, data = (cells[low], dims[low]), None, []
                if not asks[low]:
                    data.append((ids[low:high], x))
                    continue
                if data:
                    index, data = Arrays(*(np.concatenate(part) for part in zip(*data))), []
                if index is None:
                    continue
                out: list[list] = [[], [], []]
                for query_id, q in zip(ids[low:high].tolist(), x):
                    places, cos, _ = index.search(query_id, q, k)
                    out[0].append(np.full(len(places), query_id)), out[1].append(index.ids[places]), out[2].append(cos)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in out], names=["query_id", "vec_id", "score"])

    placed = dealt.repartitionById(blocks * groups, "cell").sortWithinPartitions("cell", "dim", "asked")
    found = placed.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
