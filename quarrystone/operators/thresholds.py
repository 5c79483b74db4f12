"""Choosing a similarity threshold: modularity, persistence gap, knee and silhouette, and their weighted vote.

All thresholds are swept at once: a vertex at a step is the number ``vertex * 64 + step``, so components and communities of
every step come out of one run each. Steps are 64 at most; vertices are below 2^57.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.centrality import label_propagation
from quarrystone.operators.components import connected_components
from quarrystone.operators.topology import spanning_forest

WEIGHTS = {"modularity": 2.0, "persistence": 1.5, "knee": 1.0, "silhouette": 1.0}


def swept(edges: DataFrame, grid: list[float]) -> DataFrame:
    """(step, u, v, w) with composite ends: each edge at every step whose threshold it reaches."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(t)).alias("t")) for i, t in enumerate(grid)])
    rows = edges.select("u", "v", F.col("w").cast("double").alias("w"))
    rows = rows.select("u", "v", "w", F.explode(F.filter(steps, lambda s: s["t"] <= F.col("w"))).alias("s"))
    return rows.select(F.col("s.step").alias("step"), (F.col("u") * 64 + F.col("s.step")).alias("u"), (F.col("v") * 64 + F.col("s.step")).alias("v"), "w")


def modularity_by_step(edges: DataFrame, grid: list[float], rounds: int = 10) -> DataFrame:
    """(step, modularity) of the communities that label propagation finds at each step."""
    at = swept(edges, grid)
    label = label_propagation(at.select("u", "v", "w"), rounds)
    both = at.unionByName(at.select("step", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    a = label.select(F.col("node").alias("u"), F.col("community").alias("ca"))
    b = label.select(F.col("node").alias("v"), F.col("community").alias("cb"))
    sums = both.join(a, "u").join(b, "v").groupBy("step", "ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = sums.groupBy("step").agg(F.sum("k").alias("m2"))
    part = F.col("inside") / F.col("m2") - (F.col("k") / F.col("m2")) ** 2
    return sums.join(total, "step").groupBy("step").agg(F.sum(part).alias("modularity"))


def silhouette_by_step(edges: DataFrame, grid: list[float], folder: str) -> DataFrame:
    """(step, silhouette): the mean similarity inside components less that between them; null unless there are both.

    Components come from the spanning forest, which has those of the whole graph at every threshold. A vertex carries those of
    all steps, so each edge meets its ends once and is a row for each step only where they have met."""
    root = connected_components(swept(spanning_forest(edges), grid), folder)
    vertex, at = F.shiftright("node", 6).alias("vertex"), F.struct(F.col("node").bitwiseAND(63).cast("int").alias("step"), "component")
    held = root.select(vertex, at.alias("at")).groupBy("vertex").agg(F.map_from_entries(F.collect_list("at")).alias("c"))
    a, b = (held.select(F.col("vertex").alias(end), F.col("c").alias(c)) for end, c in (("u", "ca"), ("v", "cb")))
    placed = edges.select("u", "v", F.col("w").cast("double").alias("w")).join(a, "u", "left").join(b, "v", "left")
    every = placed.select("w", "ca", "cb", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])).alias("step"))
    every = every.select("step", "w", (F.col("ca")[F.col("step")] == F.col("cb")[F.col("step")]).alias("same"))
    inside, between = F.avg(F.when(F.col("same"), F.col("w"))), F.avg(F.when(F.coalesce("same", F.lit(False)), None).otherwise(F.col("w")))
    return every.groupBy("step").agg((inside - between).alias("silhouette"))


def components_by_step(edges: DataFrame, grid: list[float], vertices: int) -> DataFrame:
    """(step, components): vertices less the forest's edges that reach the step's threshold."""
    merged = swept(spanning_forest(edges), grid).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    steps = edges.sparkSession.range(len(grid)).select(F.col("id").cast("int").alias("step"))
    return steps.join(merged, "step", "left").select("step", (F.lit(vertices) - F.coalesce("n", F.lit(0))).alias("components"))


def largest_gap(edges: DataFrame) -> DataFrame:
    """(threshold, gap): where the sorted similarities of the forest's edges fall most; the higher end, first if tied."""
    order = Window.orderBy(F.desc("w"))
    gaps = spanning_forest(edges).select("w", (F.col("w") - F.lead("w").over(order)).alias("gap")).where("gap IS NOT NULL")
    return gaps.orderBy(F.desc("gap"), F.desc("w")).limit(1).select(F.col("w").alias("threshold"), "gap")


def knee(x: np.ndarray, y: np.ndarray) -> int:
    """Place of the point farthest from the chord between the ends, on its left side; both axes scaled to 0..1."""
    x = (x - x.min()) / (np.ptp(x) + 1e-10)
    y = (y - y.min()) / (np.ptp(y) + 1e-10)
    dx, dy = x[-1] - x[0], y[-1] - y[0]
    length = np.hypot(dx, dy)
    return int(np.argmax((dx * (y - y[0]) - dy * (x - x[0])) / length)) if length > 0 else 0


def candidates(edges: DataFrame, vertices: int, folder: str, n: int = 50) -> DataFrame:
    """(method, threshold, score): a row for each method that finds one, 'auto' for the vote; no edge: no row.

    The vote is the weighted mean, snapped to the nearest threshold of the grid. Only ``n`` (64 at most) rows of each curve
    reach the driver."""
    spark = edges.sparkSession
    lo, hi = edges.agg(F.min("w"), F.max("w")).first()
    found: dict[str, tuple[float, float]] = {}
    if hi is not None:
        grid = np.linspace(float(hi) * 0.95, float(lo) + 0.05, min(n, 64))
        q = np.zeros(len(grid))
        for r in modularity_by_step(edges, grid.tolist()).collect():
            q[r["step"]] = r["modularity"]
        if q.max() > 0:
            best = int(np.argmax(q * (1 + 0.1 * np.linspace(1, 0, len(grid)))))
            found["modularity"] = (float(grid[best]), float(q[best]))
        for r in largest_gap(edges).collect():
            found["persistence"] = (r["threshold"], r["gap"])
        curve = {r["step"]: r["components"] for r in components_by_step(edges, grid.tolist(), vertices).collect()}
        bend = knee(grid, np.array([curve[i] for i in range(len(grid))], float))
        found["knee"] = (float(grid[bend]), float(curve[bend]))
        some = grid[:: max(1, len(grid) // 20)]
        scores = [(r["silhouette"], -r["step"]) for r in silhouette_by_step(edges, some.tolist(), folder).collect() if r["silhouette"] is not None]
        if scores:
            score, step = max(scores)
            found["silhouette"] = (float(some[-step]), float(score))
        mean = sum(WEIGHTS[m] * t for m, (t, _) in found.items()) / sum(WEIGHTS[m] for m in found)
        found["auto"] = (float(grid[np.argmin(np.abs(grid - mean))]), float(len(found)))
    return spark.createDataFrame([(m, t, s) for m, (t, s) in found.items()], "method string, threshold double, score double")
