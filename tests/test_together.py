"""Pairs by shared groups, against a join."""

import random

from quarrystone.operators.together import shared_counts
from quarrystone.plans import derived, registry
from quarrystone.plans.statements import STATEMENTS
from quarrystone.functions.dialect import Spark

SF = "/root/testdata/sf0.001"


def test_shared_counts(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 30)}", rng.choice("aBcdéf") + str(rng.randint(0, 9))) for _ in range(900)] + [(None, "a1"), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, x string")
    df.createOrReplaceTempView("together")
    for least in (1, 3):
        want = {tuple(r) for r in spark.sql(f"SELECT p.x, q.x, count(*) FROM together p JOIN together q ON p.g = q.g AND p.x < q.x GROUP BY 1, 2 HAVING count(*) >= {least}").collect()}
        for block in (7, 1000):
            found = [tuple(r) for r in shared_counts(df, "g", "x", least, block).collect()]
            assert len(found) == len(want) and set(found) == want
    assert shared_counts(df.limit(0), "g", "x", 1).count() == 0


def test_pairs_are_never_rows_of_a_shuffle(spark):
    """Both queries agree with their statement, and no plan of theirs joins names with names."""
    made = registry.queries()["j4_unordered_pairs"](spark, SF)
    want = derived.derived_sql(spark, SF, STATEMENTS["j4_unordered_pairs"](Spark()))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan
    assert "cooccurrence" in derived.MADE
