"""Whitening of vectors along their leading components, found by LOBPCG over products made on Spark.

A vector's entry c becomes the integer x = floor(1024 c) + 100000. Sums are exact integers; a row is centred by taking the
whole part of the mean off in integers and its fraction in double precision, before anything is multiplied. The covariance V
is never formed: a task multiplies its centred rows Y with a block W and returns Y'(Y W), whose entries Spark adds up. From
them the driver runs LOBPCG on blocks of one row per dimension: Rayleigh-Ritz on the iterate X, the residuals R and the
previous directions P, all kept orthonormal, so that V X and V P follow from what is known and an iteration costs one product,
V R. It ends when residuals taken from a fresh product are at most ``TOLERANCE`` of the first eigenvalue (the certificate), and
raises when ``MOST`` iterations don't reach that. What the driver holds depends on the dimension, not on the rows.

Edge cases: vectors that are null, empty, or hold null or non-finite entries take no part, and so have no rows; nor have
entries of 2^30 or more, whose integers couldn't be summed. Only vectors of the commonest dimension (of several the
smallest) take part. Null and repeated ids are rows of their own, equal vectors have equal results. Components are at
most ``k`` and the dimension, and those without variance (at most 1e-12 of the first) are left out, so equal vectors
alone, or one, give an empty result, as an empty table does. A deviation above 2^63 - 1 is null. Signs: a component's largest
entry is positive, the first of equals. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import stored, table

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 30)
COMPONENTS, GUARD, TOLERANCE, MOST, SEED = 8, 16, 1e-13, 400, 5


def integer_rows(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x) of the rows that take part, of all dimensions."""
    c = F.col(vector).cast("array<double>")
    good = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    rows = df.where(F.coalesce(good, F.lit(False)))
    return rows.select(F.col(id).alias("id"), F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


def _blocks(batches, at: int, dim: int):
    """(batch, its vectors as an integer array) of every batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


class Rows:
    """The rows to whiten, centred: all that the iteration asks Spark for."""

    def __init__(self, rows: DataFrame):
        sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
        self.dim, self.n = (int(sizes["dim"]), int(sizes["n"])) if sizes else (0, 0)
        self.rows = rows.where(F.size("x") == self.dim)
        if self.n:
            self.sums = self._sums()
            self.whole = np.array([s // self.n for s in self.sums], np.int64)
            self.rest = np.array([(s % self.n) / self.n for s in self.sums])
            self.trace = float(self._added(lambda y: (y * y).sum(axis=0)[:, None]).sum())

    def _sums(self) -> list[int]:
        dim = self.dim

        def run(batches):
            for _, x in _blocks(batches, 0, dim):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(x.sum(axis=0))], names=["i", "s"])

        found = self.rows.select("x").mapInArrow(run, "i long, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
        return [int(r["s"]) for r in sorted(found.collect())]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def _added(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of ``of(centred rows)``, one array a block of rows, divided by n."""
        dim, whole, rest = self.dim, self.whole, self.rest

        def run(batches):
            total = None
            for _, x in _blocks(batches, 0, dim):
                part = of((x - whole) - rest)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "v"])

        shape = of(np.zeros((1, dim))).shape
        out = np.zeros(shape).reshape(-1)
        for r in self.rows.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"] / self.n
        return out.reshape(shape)

    def product(self, w: np.ndarray) -> np.ndarray:
        """V w, for a block w of columns."""
        return self._added(lambda y: y.T @ (y @ w))

    def identity_error(self, w: np.ndarray) -> float:
        """How far the covariance of the rows projected on ``w`` is from the identity, at its worst entry."""
        k = w.shape[1]

        def moments(y: np.ndarray) -> np.ndarray:
            z = y @ w
            return np.concatenate([z.T @ z, z.sum(axis=0)[None]])

        found = self._added(moments)
        return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def _orthonormal(block: np.ndarray, against: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of what ``block``'s columns add to the orthonormal columns ``against``; it may be empty."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        if not block.shape[1]:
            break
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least]
    return block - against @ (against.T @ block)


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and their coordinates in ``basis``, whose image under V is given."""
    h = basis.T @ image
    e, u = np.linalg.eigh((h + h.T) / 2)
    return e[::-1], u[:, ::-1]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, most: int = MOST) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues of a symmetric non-negative matrix known by its products, their unit eigenvectors, and the
    certified residual (largest over the vectors, as a share of the first eigenvalue)."""
    m = min(dim, k + guard)
    x = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, m)))[0]
    vx, fresh = product(x), True
    e, u = _ritz(x, vx)
    x, vx = x @ u, vx @ u
    p = vp = np.zeros((dim, 0))
    for _ in range(most):
        r = vx - x * e
        worst = float(np.linalg.norm(r[:, :k], axis=0).max()) / max(float(e[0]), np.finfo(float).tiny)
        if worst <= tolerance or e[0] <= 0:
            if fresh:
                return e[:k], x[:, :k], worst
            x = np.linalg.qr(x)[0]
            vx, fresh, p, vp = product(x), True, np.zeros((dim, 0)), np.zeros((dim, 0))
            e, u = _ritz(x, vx)
            x, vx = x @ u, vx @ u
            continue
        w = _orthonormal(r, np.concatenate([x, p], axis=1))
        vw = product(w)
        basis, image = np.concatenate([x, w, p], axis=1), np.concatenate([vx, vw, vp], axis=1)
        e, u = _ritz(basis, image)
        e, best = e[:m], u[:, :m]
        away = best.copy()
        away[:m] = 0
        away = _orthonormal(away, best)
        x, vx, p, vp, fresh = basis @ best, image @ best, basis @ away, image @ away, False
    raise ArithmeticError(f"residuals above {tolerance} after {most} iterations: {worst}")


def _deviations(n: int, sums: list[int], x: np.ndarray) -> pa.Array:
    """Sums over dimensions of (n x - S)^2, exact; null above 2^63 - 1."""
    reach = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if reach < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        far = int(np.abs(y).max())
        if far * far * x.shape[1] < 1 << 63:
            return pa.array((y * y).sum(axis=1))
        y = y.astype(object)
    else:
        y = n * x.astype(object) - np.array(sums, object)
    return pa.array([v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()], pa.int64())


def whiten(df: DataFrame, k: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): ``k`` rows at most for each row that takes part."""
    held = Rows(stored(integer_rows(df, id, vector), "whitening-rows"))
    kind = df.schema[id].dataType
    schema = f"`{id}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not held.n or held.trace <= 0:
        return df.sparkSession.createDataFrame([], schema)
    e, w, _ = lobpcg(held.product, held.dim, min(k, held.dim))
    some = e > 1e-12 * e[0]
    e, w = e[some], w[:, some]
    w = w * np.where(w[np.abs(w).argmax(axis=0), np.arange(len(e))] < 0, -1, 1)
    w, explained = w / np.sqrt(e), e / held.trace
    error = held.identity_error(w)
    n, dim, sums, whole, rest, count = held.n, held.dim, held.sums, held.whole, held.rest, len(e)

    def run(batches):
        for batch, x in _blocks(batches, 1, dim):
            size = len(x)
            each = pa.array(np.repeat(np.arange(size), count))
            z = ((x - whole) - rest) @ w
            columns = [
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)), pa.array(np.full(size * count, n)),
                _deviations(n, sums, x).take(each), pa.array(z.reshape(-1)), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.rows.select(F.col("id").alias(id), "x").mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
