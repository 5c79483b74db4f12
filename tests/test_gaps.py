"""The largest gap between persistences, by values, against its statement over features; ties and few rows."""

from quarrystone.functions.dialect import Check
from quarrystone.plans.statements import GAP_OF_VALUES, STATEMENTS


def test_largest_gap_by_values(spark):
    by_features = STATEMENTS["w2_largest_gap"](Check())
    assert STATEMENTS["w2_largest_gap"].__code__ and "PARTITION" not in GAP_OF_VALUES
    for values in ([0.5, 0.5, 0.5], [0.9, 0.5, 0.1, 0.1], [0.9, 0.7, 0.5, 0.5, 0.3], [0.4], [], [0.2, 0.2, 0.8]):
        spark.createDataFrame([(i, v) for i, v in enumerate(values)], "feature long, persistence double").createOrReplaceTempView("features")
        try:
            found, want = spark.sql(GAP_OF_VALUES).collect(), spark.sql(by_features).collect()
            plan = spark.sql(GAP_OF_VALUES)._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.catalog.dropTempView("features")
        assert found == want and len(want) == (len(values) > 1)
        assert not values or plan.index("Window") < plan.index("Aggregate [persistence")  # what is sorted is values
