"""Directory crawls and text files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def crawl(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, size_bytes, mtime) of the files below ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(file_path, raw_text, text_length, word_count), a file a row; bytes that are not UTF-8 become replacement characters and go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    text = F.regexp_replace(F.col("content").cast("string"), "�", "")
    rows = files.select(F.col("path").alias("file_path"), text.alias("raw_text"))
    return rows.withColumns({"text_length": F.length("raw_text"), "word_count": F.coalesce(F.regexp_count("raw_text", F.lit(r"\S+")), F.lit(0))})
