"""All queries of the engine by name, with the SQL that each must agree with."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quarrystone.functions.dialect import Check, Spark
from quarrystone.plans import graphs, resolution
from quarrystone.plans import statements
from quarrystone.plans.bases import with_bases
from quarrystone.plans.derived import OWN, REDUCED, derived_sql

STATEMENTS = statements.STATEMENTS | resolution.STATEMENTS


def statement(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_sql(spark, sf_dir, STATEMENTS[name](Spark()), OWN.get(name, ()), unstored=REDUCED.get(name, ()))


def queries() -> dict:
    return {name: partial(statement, name) for name in STATEMENTS} | graphs.QUERIES


def oracle_sql() -> dict[str, str]:
    d = Check()
    return {name: with_bases(d, text(d)) for name, text in STATEMENTS.items()} | {k: with_bases(d, v) for k, v in graphs.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement("g6_similar_pairs", spark, sf_dir)


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Similar pairs (u, v, w) and the documents they join (node, path)."""
    return derived_sql(spark, sf_dir, "SELECT u, v, w FROM links"), derived_sql(spark, sf_dir, "SELECT doc_id AS node, path FROM docs")
