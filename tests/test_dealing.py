"""Documents are dealt out by the bytes of their files, so that tasks grow in number with them and not in size."""

from quarrystone.sources import tables

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_bytes(spark, monkeypatch):
    cores, rows = spark.sparkContext.defaultParallelism, spark.read.parquet(f"{SF}/documents.parquet").count()
    size = tables._bytes(spark, f"{SF}/documents.parquet")
    for share, want in ((size // (3 * cores), 3 * cores), (size * 2, cores)):
        monkeypatch.setattr(tables, "SHARE", share)
        monkeypatch.setattr(tables, "_read", {})
        tables.register(spark, SF)
        held = spark.table("documents")
        assert want <= held.rdd.getNumPartitions() <= want + 1 and held.count() == rows
