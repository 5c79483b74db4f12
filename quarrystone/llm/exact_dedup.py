"""Exact deduplication by a two-pass Bloom filter, in DataFrame functions only.

Texts are equal when identical after deleting white space. Pass 1 counts, for two bits of each text's hash, how many
rows set them; bits set by two rows or more make the filter. Pass 2 asks the filter: a row with a bit that nobody else
set is unique and passes straight through, the others ("possibly repeated") shuffle and are grouped exactly, by SHA-256.

Sizes: the filter has 16 bits a row and grows with the rows. Up to ``broadcast_bits`` (2**25: two million rows) it is
broadcast. A larger one is dealt out by hash, and the rows' hashes (a digest, an id, a length; never text) meet it there.
Hot groups: the winner of a group is a partial aggregate; groups of over a thousandth of all rows meet theirs by broadcast.

Edge cases: null text is empty text; all empty texts form one group. A null id is an id like any other, after all
others. Rows that repeat id, length and group of the winner stay together. An empty table gives an empty result.
Other columns, of any name but ``_x_*``, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.bloom import MAX_BITS, asked, filter_bits, marked_possible, twice_filter
from quarrystone.llm.common import SPACE, meet, stored, table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _hashed(docs: DataFrame, id: str, text: str) -> DataFrame:
    norm = normalised(F.col(text))
    return docs.select(
        F.col(id).alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"),
        F.sha2(norm, 256).alias("sha"),
        F.xxhash64(norm).alias("h"),
    )


def _possibly_repeated(docs: DataFrame, id: str, text: str, broadcast_bits: int) -> tuple[DataFrame, int]:
    """The rows' hashes with ``_x_again``, and how many there are."""
    hashed = stored(_hashed(docs, id, text), "dedup-hashes")
    rows = hashed.count()
    bits = filter_bits(rows)
    held = stored(twice_filter(hashed, "h", bits), "dedup-filter")
    return asked(hashed, F.col("h"), held, bits, broadcast_bits), rows


def _decided(again: DataFrame, rows: int) -> DataFrame:
    """``again`` with its group's winner and size, and whether the row is the one to keep."""
    best = F.struct(-F.col("n"), F.col("id").isNull(), F.col("id"))
    groups = again.groupBy("sha").agg(
        F.min_by("id", best).alias("keep_id"), F.max("n").alias("keep_n"), F.count(F.lit(1)).alias("group_size")
    )
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return meet(again, stored(groups, "dedup-groups"), "sha", "group_size", rows).withColumn("kept", kept)


def duplicate_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", broadcast_bits: int = MAX_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    marked, rows = _possibly_repeated(docs, id, text, broadcast_bits)
    unique = marked.where("not _x_again").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    decided = _decided(marked.where("_x_again"), rows).select(unique.columns)
    return unique.unionByName(decided).select(
        F.col("id").alias(id), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", broadcast_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Only possibly repeated rows shuffle, as digests; the rows to go are
    then met by what a filter of them may hold, known by id, length and digest, and all else passes straight through."""
    marked, rows = _possibly_repeated(docs, id, text, broadcast_bits)
    losers = _decided(marked.where("_x_again"), rows).where("not kept").select("id", "n", "sha", "h").distinct()
    losers = stored(losers.select(F.struct("id", "n", "sha").alias("_x_row"), F.xxhash64("id", "n", "h").alias("_x_key")), "dedup-losers")
    norm, n = normalised(F.col(text)), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    asking = marked_possible(docs.withColumn("_x_key", F.xxhash64(F.col(id), n, F.xxhash64(norm))), "_x_key", losers)
    stays = asking.where("_x_again").withColumn("_x_row", F.struct(F.col(id).alias("id"), n.alias("n"), F.sha2(norm, 256).alias("sha")))
    gone = losers.select("_x_row")
    stays = stays.join(gone, stays["_x_row"].eqNullSafe(gone["_x_row"]), "left_anti").select(docs.columns)
    return asking.where("not _x_again").select(docs.columns).unionByName(stays)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
