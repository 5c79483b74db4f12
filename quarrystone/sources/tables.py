"""Raw tables as views of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Documents are dealt out after the scan, as one row group, however large its texts, is one task: so many bytes of files to a task, and
#: as many tasks as cores at least.
SHARE = 8 << 20
_read: dict[tuple, dict[str, DataFrame]] = {}


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the tables' files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf)
        if files.exists(path):
            found += [f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in files.listStatus(path)]
    return " ".join(found)


def _bytes(spark: SparkSession, where: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def register(spark: SparkSession, sf_dir: str) -> None:
    """Each table of the folder as a view; plans made from it keep the folder they were made for. Schemas are read once for
    the files as they are."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir))
    if key not in _read:
        _read[key] = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
        parts = max(spark.sparkContext.defaultParallelism, -(-_bytes(spark, f"{sf_dir}/documents.parquet") // SHARE))
        _read[key]["documents"] = _read[key]["documents"].repartition(parts)
    for name, held in _read[key].items():
        held.createOrReplaceTempView(name)
