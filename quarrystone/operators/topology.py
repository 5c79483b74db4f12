"""Spanning forests, persistence and Betti numbers of a weighted similarity graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Kruskal: places of the maximum spanning forest's edges; ties by ends."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i in np.lexsort((v, u, -w)).tolist():
        a, b = root(u[i]), root(v[i])
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(i)
    return np.array(kept, np.int64)


def _reduced(batches):
    """The forest of a partition, holding no more than it and one batch."""
    held = None
    for part in batches:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        held = held.iloc[_forest(held["u"].to_numpy(), held["v"].to_numpy(), held["w"].to_numpy())].reset_index(drop=True)
    if held is not None:
        yield held


def spanning_forest(edges: DataFrame, fan_in: int = 8) -> DataFrame:
    """(u, v, w) of the maximum spanning forest. The forest of a union is the forest of the parts' forests, so parts are
    reduced in tasks of their own, and their forests are dealt out anew and merged as a tree: each level has a ``fan_in``-th of
    the tasks before it, and no task is sent more than about ``fan_in`` forests, each below the vertex count."""
    rows = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w")).where("u <> v AND w IS NOT NULL")
    parts = rows.rdd.getNumPartitions()
    schema = "u long, v long, w double"
    rows = rows.mapInPandas(_reduced, schema)
    while parts > 1:
        parts = -(-parts // fan_in)
        rows = rows.repartition(parts).mapInPandas(_reduced, schema)
    return rows


def h0_persistence(edges: DataFrame, vertices: int) -> DataFrame:
    """(birth, death, persistence): each forest edge kills a component at its similarity; the rest live on (null death)."""
    forest = spanning_forest(edges)
    finite = forest.select(F.lit(1.0).alias("birth"), F.col("w").alias("death"), (1.0 - F.col("w")).alias("persistence"))
    rest = forest.agg((F.lit(vertices) - F.count(F.lit(1))).alias("n"))
    forever = rest.where("n > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return finite.unionByName(forever.select(F.lit(1.0).alias("birth"), F.lit(None).cast("double").alias("death"), F.lit(None).cast("double").alias("persistence")))


def betti_curve(edges: DataFrame, vertices: int, thresholds: list[float]) -> DataFrame:
    """(threshold, betti_0, betti_1, num_edges): components and independent cycles of the graph of edges at each threshold.

    Every edge is counted once, at the highest threshold it reaches; the few counts are then summed from above."""
    spark = edges.sparkSession
    grid = sorted(float(t) for t in thresholds)
    step = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col("w"))) - 1
    forest = spanning_forest(edges).select("w", F.lit(1).alias("f"))
    every = edges.select(F.col("w").cast("double").alias("w"), F.lit(0).alias("f"))
    counted = every.unionByName(forest).groupBy(step.alias("step")).agg(F.count(F.when(F.col("f") == 0, 1)).alias("n"), F.count(F.when(F.col("f") == 1, 1)).alias("k"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "step int, threshold double").join(counted, "step", "left")
    above = Window.partitionBy().orderBy(F.desc("step"))  # over the grid's rows
    summed = rows.select("threshold", F.sum(F.coalesce("n", F.lit(0))).over(above).alias("num_edges"), F.sum(F.coalesce("k", F.lit(0))).over(above).alias("k"))
    beta0 = F.lit(vertices) - F.col("k")
    return summed.select("threshold", beta0.alias("betti_0"), (F.col("num_edges") - F.col("k")).alias("betti_1"), "num_edges")
