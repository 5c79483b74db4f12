"""Connected components of an edge list, by alternating large-star and small-star rounds (O(log^2 n) of them)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame, folder: str) -> DataFrame:
    """Written to the shared folder, so that neither lineage nor lost executors matter to the rounds that follow."""
    path = f"{folder}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _meet(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(u, v, m) of all edges: m is the least neighbour (from ``least``) of the smaller end v, or null.

    Nodes with more than max(64, total / 2**14) larger neighbours are fewer than 2**14 or a 64th of all edges; theirs are
    broadcast, so that no hub's edges meet in one task."""
    least = least.withColumnRenamed("u", "node")
    hubs = edges.groupBy(F.col("v").alias("node")).count().where(F.col("count") > max(64, total >> 14)).select("node")
    hubs = hubs.join(least, "node", "left").select("node", "m", F.lit(True).alias("hub"))
    marked = edges.join(F.broadcast(hubs), F.col("v") == F.col("node"), "left").drop("node")
    rest = marked.where("hub is null").select("u", "v").join(least, F.col("v") == F.col("node"), "left")
    return marked.where("hub").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each edge's larger end goes to the least neighbour of the smaller end, if that is smaller still."""
    return _meet(edges, _least(edges), total).select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the least of them. After a large star few are left to a node."""
    met = edges.join(_least(edges), "u")
    return met.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, folder: str, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) of every node with an edge to another; component: the smallest node reachable.

    ``folder`` is shared by all executors. Null ends and loops are left out. A hot node's edges are never gathered:
    minima are partial aggregates, and hubs meet theirs by broadcast.
    """
    u, v = F.col(a), F.col(b)
    edges = _kept(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), folder)
    before, total = None, edges.count()
    while True:
        edges = _kept(_small_star(_large_star(edges, total)), folder)
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(xxhash64(v, u))").alias("y")).first()
        if row == before or not row["n"]:
            break
        before = row
    # the rounds' broadcasts and shuffle files go when the driver's JVM collects, which may else be in half an hour
    edges.sparkSession.sparkContext._jvm.System.gc()
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
