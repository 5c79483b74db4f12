"""Centroid clustering (Lloyd's rounds on integers) with ball-tree filtering.

Rows are cut, where they lie, into blocks of at most ``BLOCK`` vectors, and a metric tree is built over each: a node's ball
has a centre, a radius that holds all its vectors, their count and their integer sum. Blocks are stored once. In a round each
block is filtered from the root down, all nodes of a level at a time: a centroid stays a candidate of a ball only if by the
triangle inequality one of its vectors could be as near to it as to the ball's nearest. With one candidate left, the whole
ball's count and sum go to it; leaves with more are decided vector by vector, on exact integers. Comparisons of balls leave
room for rounding, so ties are always decided exactly. Blocks return counts and sums for each centroid; Spark adds them up
(exactly: sums are of decimal type), and the driver holds one row a centroid.

Edge cases: vectors that are null, of another length than ``dim``, or hold null or non-finite components take no part; nor
do those with a component of 2^20 or more in size, as their squared distances would not fit. With fewer vectors than centroids
there are as many as vectors; equal vectors may be two centroids, of which the smaller number takes all. Equal ids are
ordered by their vectors; a null id comes after all others when the first centroids are chosen, and is a row like others. An
inertia above 2^63 - 1 is null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import stored, table

SCALE, LARGEST, DIM, CENTROIDS, ROUNDS = 64, float(1 << 20), 64, 16, 3
BLOCK, LEAF = 4096, 32


def integer_rows(df: DataFrame, id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, x) of the rows that take part."""
    c = F.col(vector).cast("array<double>")
    good = (F.size(c) == dim) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(id).alias("id"), F.transform(c, lambda v: F.floor(v * scale)).alias("x"))


class BallTree:
    """A metric tree over one block's vectors, which lie in the order of its leaves. Node i's vectors are places low[i] to
    high[i]; its children, if any, are left[i] and left[i] + 1 (0: a leaf); nodes are stored level by level."""

    FIELDS = ("low", "high", "left", "radius", "centre", "sums")

    def __init__(self, x: np.ndarray, low, high, left, radius, centre, sums):
        self.x, self.low, self.high, self.left, self.radius, self.centre, self.sums = x, low, high, left, radius, centre, sums

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> tuple["BallTree", np.ndarray]:
        """The tree and the order in which it has put the rows of ``x``. A ball is split at the median between two of its
        vectors that lie far apart: the farthest from its centre, and the farthest from that one."""
        order = np.arange(len(x))
        low, high, left, radius, centre, sums = [0], [len(x)], [], [], [], []
        i = 0
        while i < len(low):
            a, b = low[i], high[i]
            held = x[order[a:b]]
            total = held.sum(axis=0)
            mean = total / (b - a)
            away = ((held - mean) ** 2).sum(axis=1)
            radius.append(float(np.sqrt(away.max())) * (1 + 1e-9) + 1e-9)
            centre.append(mean), sums.append(total)
            if b - a <= leaf or not away.max():
                left.append(0)
            else:
                one = held[away.argmax()]
                other = held[((held - one) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(held @ (other - one), half)]
                left.append(len(low))
                low += [a, a + half]
                high += [a + half, b]
            i += 1
        tree = cls(x[order], *(np.array(v, np.int64) for v in (low, high, left)), np.array(radius), np.array(centre), np.array(sums, np.int64))
        return tree, order

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(v).tobytes() for v in (self.x, *(getattr(self, f) for f in self.FIELDS))]

    @classmethod
    def unpacked(cls, blobs: list[bytes], dim: int) -> "BallTree":
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64, np.float64, np.int64)
        held = [np.frombuffer(b, k) for b, k in zip(blobs, kinds)]
        return cls(held[0].reshape(-1, dim), *held[1:5], held[5].reshape(-1, dim), held[6].reshape(-1, dim))

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Counts and sums of the vectors nearest to each centroid, and how many vectors were compared one by one."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        size = (centroids * centroids).sum(axis=1)
        nodes, open_, compared = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool), 0
        while len(nodes):
            m = self.centre[nodes]
            away = np.sqrt(np.maximum(0, (m * m).sum(axis=1)[:, None] - 2 * (m @ centroids.T) + size))
            room = 1e-6 * (1 + np.sqrt(size.max()) + np.sqrt((m * m).sum(axis=1)))
            away[~open_] = np.inf
            open_ = open_ & (away <= (away.min(axis=1) + 2 * self.radius[nodes] + room)[:, None])
            one = open_.sum(axis=1) == 1
            to = open_[one].argmax(axis=1)
            np.add.at(counts, to, (self.high - self.low)[nodes[one]])
            np.add.at(sums, to, self.sums[nodes[one]])
            nodes, open_ = nodes[~one], open_[~one]
            leaves = self.left[nodes] == 0
            for i, among in zip(nodes[leaves].tolist(), open_[leaves]):
                x, some = self.x[self.low[i] : self.high[i]], np.flatnonzero(among)
                to = some[(size[some] - 2 * (x @ centroids[some].T)).argmin(axis=1)]
                np.add.at(counts, to, 1)
                np.add.at(sums, to, x)
                compared += len(x)
            nodes, open_ = self.left[nodes[~leaves]], open_[~leaves]
            nodes, open_ = np.concatenate([nodes, nodes + 1]), np.concatenate([open_, open_])
        return counts, sums, compared


def ball_trees(rows: DataFrame, dim: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """One row a block: its tree, packed. Blocks are runs of the partitions' rows; nothing is shuffled."""
    names = ["x", *BallTree.FIELDS]

    def run(batches):
        held, many = [], 0

        def made():
            tree, _ = BallTree.build(np.concatenate(held), leaf)
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in tree.packed()], names=names)

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            while len(x):
                held.append(x[: block - many])
                many, x = many + len(held[-1]), x[block - many :]
                if many == block:
                    yield made()
                    held, many = [], 0
        if many:
            yield made()

    return rows.select("x").mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def first_centroids(rows: DataFrame, count: int) -> np.ndarray:
    """The vectors whose ids hash lowest."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256)
    some = rows.select(hashed.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(count).collect()
    return np.array([r["x"] for r in some], np.int64)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: every vector to its nearest, then the floor of each one's mean."""
    dim = centroids.shape[1]

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                n, s, _ = BallTree.unpacked(row, dim).filtered(centroids)
                counts, sums = counts + n, sums + s
        at, dims = np.divmod(np.arange(sums.size), dim)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dims), pa.array(counts[at]), pa.array(sums.reshape(-1))], names=["cluster", "at", "n", "s"])

    found = trees.mapInArrow(run, "cluster long, at long, n long, s long").groupBy("cluster", "at")
    found = found.agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = centroids.copy()
    for r in found.where("n > 0").collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(df: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row that takes part."""
    spark = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    rows = stored(integer_rows(df, id, vector, dim, scale), "cluster-rows")
    centroids = first_centroids(rows, count)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = stored(ball_trees(rows, dim), "ball-trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    size = (centroids * centroids).sum(axis=1)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                part = size - 2 * (x @ centroids.T)
                to = part.argmin(axis=1)
                far = part[np.arange(len(x)), to] + (x * x).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    placed = rows.mapInArrow(run, f"id {kind}, cluster int, distance long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # one row a centroid
    fits = lambda v: v if v < 1 << 63 else None
    whole = fits(sum(int(r["s"]) for r in per))
    facts = [(r["cluster"], fits(int(r["s"])), whole, digests[r["cluster"]]) for r in per]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = ROUNDS) -> str:
    def assigned(cents: str) -> str:
        return f"""SELECT k.vec_id, k.x, c.num AS num, list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM kept k CROSS JOIN {cents} c QUALIFY row_number() OVER (PARTITION BY k.vec_id ORDER BY d, c.num) = 1"""

    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({assigned(f"c{i}")}),
        m{i} AS (SELECT num, pos, sum(v) AS s, count(*) AS n FROM (SELECT num, unnest(x) AS v, unnest(range(1, {DIM} + 1)) AS pos FROM a{i}) GROUP BY num, pos),
        c{i + 1} AS MATERIALIZED (SELECT c.num, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
            SELECT num, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY pos) AS x FROM m{i} GROUP BY num) n ON n.num = c.num)""")
    return f"""WITH kept AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIM}),
    c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS num, x FROM kept QUALIFY num < {CENTROIDS}),
    {", ".join(steps)},
    final AS MATERIALIZED ({assigned(f"c{rounds}")})
    SELECT f.vec_id, f.num AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.num))::BIGINT AS cluster_inertia,
        (sum(f.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM final f JOIN c{rounds} c ON c.num = f.num"""


OP12_SQL = _op12_sql()
