"""Shared helpers: scratch tables in the cluster's shared folder, and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.scratch import shared_folder

#: What the contracts call white space, as a Java/Python character class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the one all executors share (``spark.checkpoint.dir``); it goes when the application ends.

    Only a local master may go without the setting; then one temporary folder is made and set for the session.
    """
    return shared_folder(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_blocks(df: DataFrame, text: str, megabytes: int = 8) -> int:
    """How many partitions of about ``megabytes`` the texts fill; one counting job over the column."""
    row = df.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    size = int(row["b"] or 0) + 64 * int(row["n"])
    return max(8, -(-size // (megabytes << 20)))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows and about two megabytes for this session: rows with whole texts are large, and
    executors hold a batch per task on both sides of the pipe. Plans are made when results are asked for, so the setting stays."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 2 << 20)):
        name = "spark.sql.execution.arrow." + name
        held = str(spark.conf.get(name)).lower().removesuffix("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(name, str(most))


def meet(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups`` (one row a key, with its ``size``). Groups of over a thousandth of all rows, a thousand
    at most, are broadcast, so that no hot group's rows meet in one task; the others are joined by key."""
    hot = F.col(size) * 1000 > total
    marked = rows.join(F.broadcast(groups.where(hot)), key, "left")
    rest = marked.where(F.col(size).isNull()).select(rows.columns).join(groups.where(~hot), key)
    return marked.where(F.col(size).isNotNull()).unionByName(rest)


def release() -> None:
    """Gives freed memory of a worker back to the system, where the C library can: workers live from task to task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_held: dict[tuple, object] = {}


def worker_own(key: tuple, make):
    """An object that a worker keeps from task to task: one at most, the last asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def pieces(batches, column: str, max_bytes: int = (1 << 20) - 1024, max_rows: int = 60_000):
    """Arrow batches cut into runs of rows with about ``max_bytes`` of text; a longer text stands alone."""
    release()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        at = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
        low = 0
        while low < n:
            high = int(np.searchsorted(at, at[low] + max_bytes, "right")) - 1
            high = min(max(high, low + 1), n, low + max_rows)
            yield batch.slice(low, high - low)
            low = high
    release()


def binary_array(blobs) -> pa.Array:
    return pa.array(blobs, pa.binary())
