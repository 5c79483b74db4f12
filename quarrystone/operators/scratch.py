"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``, which is then the checkpoint folder too; only a local master may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("quarrystone.shared.dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
            spark.conf.set("quarrystone.shared.dir", found)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return own_folder(spark, found)


_own: dict[tuple[str, str], str] = {}


def own_folder(spark: SparkSession, base: str) -> str:
    """The application's own folder in ``base``, deleted with all it holds when the application ends."""
    key = (spark.sparkContext.applicationId, base)
    if key not in _own:
        _own[key] = passing(spark, f"{base.rstrip('/')}/quarrystone-{key[0]}")
    return _own[key]


def passing(spark: SparkSession, path: str) -> str:
    """``path``, to be deleted with all it holds when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes ``path``, which is no longer read, with all it holds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
