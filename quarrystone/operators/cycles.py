"""Persistent cycles (H1) of a similarity graph, a connected component at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.components import connected_components


def cycles(rows: list[tuple[int, int, float]]) -> list[tuple[float, float]]:
    """(birth, death) as distances 1 - w of the flag complex of the edges; what no triangle fills dies at 1.

    The boundary matrix of triangles is reduced over two elements; a triangle enters with its longest edge."""
    place = {}
    for a, b, w in sorted(((min(u, v), max(u, v), w) for u, v, w in rows if u != v), key=lambda e: (-e[2], e[0], e[1])):
        place.setdefault((a, b), (len(place), 1.0 - w))
    near: dict[int, set[int]] = {}
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    born, triangles, length = [], [], [0.0] * len(place)
    for (a, b), (i, far) in place.items():
        length[i] = far
        for c in near.get(a, set()) & near.get(b, set()):
            triangles.append((i, place[min(a, c), max(a, c)][0], place[min(b, c), max(b, c)][0]))
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        if root(a) == root(b):
            born.append(i)
        parent[root(a)] = root(b)
    held: dict[int, set[int]] = {}
    died: dict[int, float] = {}
    for sides in triangles:
        column = set(sides)
        while column and max(column) in held:
            column ^= held[max(column)]
        if column:
            held[max(column)] = column
            died[max(column)] = length[sides[0]]
    return [(length[i], died.get(i, 1.0)) for i in born if died.get(i, 1.0) > length[i]]


def h1_persistence(edges: DataFrame, folder: str, max_edges: int = 200_000) -> DataFrame:
    """(birth, death, persistence) of every cycle that lives some time, as distances.

    Components are independent below distance 1, where all of them meet, so each is a task's group. One of more than
    ``max_edges`` edges raises: it is neither cut nor sampled. Null ends and loops are left out."""
    rows = edges.select("u", "v", F.col("w").cast("double").alias("w")).where("u <> v AND w IS NOT NULL")
    placed = rows.join(connected_components(rows, folder), rows["u"] == F.col("node")).select("component", "u", "v", "w")
    largest = placed.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > max_edges:
        raise ValueError(f"a component of {largest} edges; cycles take {max_edges} at most")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = cycles(list(zip(part["u"].tolist(), part["v"].tolist(), part["w"].tolist())))
        return pd.DataFrame([(b, d, d - b) for b, d in found], columns=["birth", "death", "persistence"], dtype=float)

    return placed.groupBy("component").applyInPandas(run, "birth double, death double, persistence double")
