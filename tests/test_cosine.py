"""Similar pairs by products of blocks against the join of all terms."""

import numpy as np
import pytest

from quarrystone.operators import cosine
from quarrystone.operators.cosine import similar_pairs
from quarrystone.plans import derived
from quarrystone.plans.registry import queries


def _rows(seed, n, terms, hot):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        row = {f"hot{k}": 1.0 for k in range(hot) if rng.random() < 0.9}
        row |= {f"t{int(k)}": float(rng.random()) for k in rng.integers(0, terms, 6)}
        size = sum(w * w for w in row.values()) ** 0.5
        out += [(i * 7 % (2 * n), t, w / size) for t, w in row.items()]
    return out


@pytest.mark.parametrize("seed,n,terms,hot,block", [(0, 80, 30, 0, 16), (1, 120, 400, 2, 1000), (2, 60, 15, 3, 7)])
def test_pairs_equal_the_join(spark, seed, n, terms, hot, block):
    rows = _rows(seed, n, terms, hot)
    held = {}
    for i, t, w in rows:
        held.setdefault(i, {})[t] = w
    want, order = {}, sorted(held)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            s = round(sum(w * held[b].get(t, 0) for t, w in held[a].items()), 6)
            if s >= 0.3:
                want[(a, b)] = s
    df = spark.createDataFrame(rows + [(None, "t1", 1.0), (1, None, 1.0), (1, "t1", None)], "id long, term string, w double")
    found = similar_pairs(df, n, 0.3, block=block)
    got = [(r.u, r.v, r.w) for r in found.collect()]
    assert len(got) == len(want) and {(u, v) for u, v, _ in got} == want.keys()
    assert all(abs(w - want[(u, v)]) < 2e-6 for u, v, w in got)


def test_repeated_terms_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.5), (2, "a", 1.0), (3, "b", 1.0)], "id long, term string, w double")
    assert [tuple(r) for r in similar_pairs(df, 3, 0.9).collect()] == [(1, 2, 1.0)]
    assert similar_pairs(df.limit(0), 0, 0.1).collect() == []


def test_blocks_meet_in_groups(spark):
    """250 blocks go to 32 groups each, not to 250 blocks; few blocks stay groups of their own, for the sake of tasks."""
    assert [cosine._groups(n) for n in (1, 5, 15, 25, 250)] == [1, 5, 15, 9, 32]
    rows = _rows(4, 90, 60, 1)
    df = spark.createDataFrame(rows, "id long, term string, w double").repartition(4)
    want = sorted(tuple(r) for r in similar_pairs(df, 90, 0.3, block=1000).collect())
    got = sorted(tuple(r) for r in similar_pairs(df, 90, 0.3, block=3).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-6)
    assert cosine._met(df, 90, 3).count().agg({"count": "sum"}).first()[0] <= 30 * cosine._groups(30) < 30 * 30


@pytest.mark.parametrize("block", [3, 1000])
def test_links_of_labels_are_counted_in_cells(spark, block):
    """Ids that have a label twice count twice, those without none."""
    df = spark.createDataFrame(_rows(5, 90, 60, 1), "id long, term string, w double")
    labels = {i: (i % 4, 2 if i % 9 == 0 else 1) for i in range(200) if i % 7}
    want = {}
    for u, v, _ in similar_pairs(df, 90, 0.3, block=block).collect():
        if u in labels and v in labels:
            (a, m), (b, n) = labels[u], labels[v]
            for label in {a, b}:
                want.setdefault(label, [0, 0])[a != b] += m * n
    given = spark.createDataFrame([(i, *x) for i, x in labels.items()], "id long, label long, times long")
    assert {r[0]: [r[1], r[2]] for r in cosine.link_counts(df, 90, 0.3, given, block=block).collect()} == want


@pytest.mark.parametrize("name", ["g14_snapped_threshold", "g16_component_degree", "g21_community_edges"])
def test_pairs_are_not_stored_for_a_summary(spark, name):
    """What only counts or reduces pairs doesn't write them; once they are stored, the result is the same."""
    derived._made.clear()
    sf = "/root/testdata/sf0.001"
    alone = sorted(map(tuple, queries()[name](spark, sf).collect()))
    assert all("pairs" not in made for made in derived._made.values())
    derived.derived_sql(spark, sf, "SELECT * FROM links")
    assert alone == sorted(map(tuple, queries()[name](spark, sf).collect()))
    derived._made.clear()
    derived.derived_sql(spark, sf, "SELECT * FROM links")
    assert alone == sorted(map(tuple, queries()[name](spark, sf).collect()))
