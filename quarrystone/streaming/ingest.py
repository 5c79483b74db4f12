"""Text extraction over a stream of tables: the row-local part of ingestion. The engine's other operators are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """(doc_id, text_length, word_count) of documents as their files arrive."""
    rows = spark.readStream.schema(schema).parquet(folder)
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    return rows.select("doc_id", F.length("text").alias("text_length"), words.alias("word_count"))


def write_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once by the checkpoint; stops when what is there has been read."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
