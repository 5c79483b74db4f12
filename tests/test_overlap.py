"""What the sides of given pairs have in common, against joins; the queries on it carry no lists of folders or neighbours."""

import random

from quarrystone.functions.dialect import Spark
from quarrystone.operators import overlap
from quarrystone.operators.overlap import shared_groups, shared_neighbours
from quarrystone.operators.together import neighbour_bits, shared_counts, shared_total
from quarrystone.plans import derived, registry
from quarrystone.plans.bases import BASES, with_bases

SF = "/root/testdata/sf0.001"


def _tables(spark):
    rng = random.Random(5)
    name = lambda: rng.choice("aBcdéf") + str(rng.randint(0, 9))
    rows = spark.createDataFrame([(f"g{rng.randint(0, 90)}", name()) for _ in range(700)] + [(None, "a1"), ("g1", None), ("g1", "a1"), ("g1", "a1")], "g string, x string")
    pairs = spark.createDataFrame([(name(), name(), float(i)) for i in range(300)] + [("none", "a1", 1.0), (None, "a1", 2.0), ("a1", "a1", 3.0)], "p string, q string, s double")
    return rows, pairs


def test_groups_and_neighbours_in_common(spark, monkeypatch):
    rows, pairs = _tables(spark)
    monkeypatch.setattr(overlap, "GROUPS", 64)
    groups, near = {}, {}
    for g, x in set(map(tuple, rows.collect())):
        if g is not None and x is not None:
            groups.setdefault(x, set()).add(g)
    links = shared_counts(rows, "g", "x", 2)
    for a, b, _ in links.collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    bits = neighbour_bits(rows, "g", "x", 2, 7).cache()
    of = lambda held, x: held.get(x, set())
    for block in (7, 1000):
        found = sorted(map(tuple, shared_groups(pairs, "p", "q", rows, "x", "g", block).collect()), key=str)
        assert found == sorted(((p, q, s, len(of(groups, p) & of(groups, q))) for p, q, s in pairs.collect()), key=str)
        found = sorted(map(tuple, shared_neighbours(pairs, "p", "q", bits, block).collect()), key=str)
        assert found == sorted(((p, q, s, len(of(near, p) & of(near, q)), len(of(near, p)), len(of(near, q))) for p, q, s in pairs.collect()), key=str)
        assert shared_total(rows, "g", "x", 2, block).first()[0] == links.count() > 0
    assert shared_total(rows.limit(0), "g", "x", 2).first()[0] == 0
    assert {r[-1] for r in shared_groups(pairs, "p", "q", rows.limit(0), "x", "g").collect()} == {0}


def test_whole_numbers_share_groups(spark):
    rows = spark.createDataFrame([(i % 7, i % 40) for i in range(400)], "g long, x long")
    rows.createOrReplaceTempView("numbered")
    want = spark.sql("SELECT p.x, q.x, count(*) FROM numbered p JOIN numbered q ON p.g = q.g AND p.x < q.x GROUP BY 1, 2").collect()
    assert sorted(map(tuple, shared_counts(rows, "g", "x", 1, 9).collect())) == sorted(map(tuple, want))


def test_made_tables_agree_with_their_statements(spark):
    for name in ("met_pairs", "acquainted", "cooccurrence_count"):
        made = derived.derived_sql(spark, SF, f"SELECT * FROM {name}")
        want = derived.derived_sql(spark, SF, BASES[name](Spark()))
        assert sorted(map(str, made.collect())) == sorted(map(str, want.select(*made.columns).collect())) and want.count() > 0


def test_pairs_carry_no_lists(spark):
    """The queue is read once by what scores it, and joined with no list of folders or neighbours."""
    for name in ("e9_network_overlap", "e9_network_jaccard", "e13_alternative_scores", "e17_queue_statistics"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "array_intersect" not in plan and "collect_" not in plan
    text = with_bases(Spark(), registry.STATEMENTS["e17_queue_statistics"](Spark()), derived.STORED)
    assert text.count("queue") == 1
    assert "cooccurrence_count" in registry.STATEMENTS["c6_view_list"](Spark())
