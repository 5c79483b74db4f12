"""A folder of Parquet tables: listing, counts, clearing, resets by feature and replaced partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def tables(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, n) of every table; an empty folder gives no rows."""
    parts = [spark.read.parquet(f"{folder}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t in tables(spark, folder)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "table_name string, n long")


def drop(spark: SparkSession, folder: str, names: list[str], dry_run: bool = True) -> list[str]:
    """Tables of ``names`` that are there; gone afterwards unless ``dry_run``."""
    found = [n for n in names if n in tables(spark, folder)]
    for n in [] if dry_run else found:
        fs, p = _fs(spark, f"{folder}/{n}.parquet")
        fs.delete(p, True)
    return found


def rewrite(spark: SparkSession, folder: str, name: str, keep: Column) -> None:
    """The table without the rows that fail ``keep`` (or give null): written beside it, then put in its place."""
    path = f"{folder}/{name}.parquet"
    spark.read.parquet(path).where(keep).write.mode("overwrite").parquet(path + ".new")
    fs, old = _fs(spark, path)
    fs.delete(old, True)
    fs.rename(_fs(spark, path + ".new")[1], old)


def reset(spark: SparkSession, folder: str, features: dict[str, dict[str, Column | None]], feature: str, dry_run: bool = True) -> list[str]:
    """Clears the tables of a feature; a table with a condition keeps the rows that meet it (say, manual aliases)."""
    due = [t for t in features[feature] if t in tables(spark, folder)]
    for t in [] if dry_run else due:
        keep = features[feature][t]
        rewrite(spark, folder, t, F.lit(False) if keep is None else keep)
    return due


def replace_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Writes results; partitions that ``rows`` holds (a threshold, an algorithm) are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
