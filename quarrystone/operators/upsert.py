"""Merging incoming rows into a table by key, with a rule for each column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = {
    "incoming": lambda old, new, hit: F.when(hit, new).otherwise(old),
    "existing": lambda old, new, hit: old,
    "least": lambda old, new, hit: F.least(old, new),
    "greatest": lambda old, new, hit: F.greatest(old, new),
    "coalesce": lambda old, new, hit: F.coalesce(new, old),
}


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """``existing`` with ``incoming`` merged in: one full outer join on null-safe keys. Columns are keys and those of ``rules``.

    A rule decides rows that both hold: incoming, existing, least, greatest (nulls lose) or coalesce (incoming unless null).
    ``incoming`` holds a key once; an empty side leaves the other as it is."""
    a = existing.select(*keys, *rules).withColumn("_old", F.lit(True)).alias("a")
    b = incoming.select(*keys, *rules).withColumn("_new", F.lit(True)).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    hit, had = F.col("b._new").isNotNull(), F.col("a._old").isNotNull()
    key = [F.when(had, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    merged = [F.when(had, RULES[r](F.col(f"a.{c}"), F.col(f"b.{c}"), hit)).otherwise(F.col(f"b.{c}")).alias(c) for c, r in rules.items()]
    return a.join(b, same, "full").select(*key, *merged)
