"""The silhouette of all steps, with each edge meeting its ends once."""

import random

from quarrystone.operators.thresholds import silhouette_by_step


def _silhouette(edges, t):
    """By hand: components of what reaches ``t``; ends without such an edge are in none."""
    part = {}
    for u, v, w in edges:
        if w >= t:
            a, b = part.setdefault(u, u), part.setdefault(v, v)
            part = {n: (min(a, b) if c in (a, b) else c) for n, c in part.items()}
    inside = [w for u, v, w in edges if u in part and part[u] == part.get(v)]
    between = [w for u, v, w in edges if not (u in part and part[u] == part.get(v))]
    return sum(inside) / len(inside) - sum(between) / len(between) if inside and between else None


def test_silhouette_by_step(spark, tmp_path):
    rng = random.Random(3)
    edges = sorted({(u, v): rng.randint(10, 95) / 100 for u in range(-2, 40) for v in range(u + 1, 40) if rng.random() < 0.08}.items())
    edges = [(u, v, w) for (u, v), w in edges]
    grid = [0.9, 0.8, 0.6, 0.4, 0.1]
    rows = spark.createDataFrame(edges, "u long, v long, w double")
    found = silhouette_by_step(rows, grid, str(tmp_path))
    for r in found.collect():
        want = _silhouette(edges, grid[r["step"]])
        assert want == r["silhouette"] or abs(want - r["silhouette"]) < 1e-9
    assert found.count() == len(grid)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
