"""Bloom filters as tables of 64-bit words, in DataFrame functions only.

A hash sets two bits of one word, so a lookup is one join. A filter has 16 bits an entry, however many there are. Up to
``MAX_BITS`` (2**19 rows of 16 bytes) it is broadcast; a larger one is dealt out by word, and what asks it meets it by shuffle,
so only narrow rows should. Where rows with whole texts ask, the filter is held to ``MAX_BITS`` and lets more through, never less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 25


def filter_bits(entries: int) -> int:
    return 1 << max(10, (16 * max(1, entries) - 1).bit_length())


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def places(h: Column, bits: int) -> tuple[Column, Column]:
    """The filter's word of a hash, and its bits there."""
    return F.pmod(h, F.lit(bits // 64)), _bit(F.shiftrightunsigned(h, 52)).bitwiseOR(_bit(F.shiftrightunsigned(h, 58)))


def once_filter(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """(_x_word, _x_bits) of all hashes."""
    word, mask = places(F.col(h), bits)
    return hashes.select(word.alias("_x_word"), mask.alias("_x_mask")).groupBy("_x_word").agg(F.bit_or("_x_mask").alias("_x_bits"))


def twice_filter(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """(_x_word, _x_bits) of the bits that two rows or more set."""
    word = F.pmod(F.col(h), F.lit(bits // 64)).alias("_x_word")
    at = [F.shiftrightunsigned(F.col(h), n).bitwiseAND(F.lit(63)).cast("int") for n in (52, 58)]
    set_by = hashes.select(word, F.explode(F.array_distinct(F.array(*at))).alias("_x_at")).groupBy("_x_word", "_x_at").count()
    return set_by.where("count > 1").groupBy("_x_word").agg(F.bit_or(_bit(F.col("_x_at"))).alias("_x_bits"))


def asked(df: DataFrame, h: Column, held: DataFrame, bits: int, broadcast_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with ``_x_again``: whether the filter may hold the row's hash. It is broadcast up to ``broadcast_bits``."""
    word, mask = places(h, bits)
    held = F.broadcast(held) if bits <= broadcast_bits else held
    found = df.withColumns({"_x_word": word, "_x_mask": mask}).join(held, "_x_word", "left")
    again = F.coalesce(F.col("_x_bits").bitwiseAND(F.col("_x_mask")) == F.col("_x_mask"), F.lit(False))
    return found.withColumn("_x_again", again).drop("_x_word", "_x_mask", "_x_bits")


def marked_possible(df: DataFrame, key: str, keys: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with ``_x_again``: whether ``key`` may be among ``keys``' (a stored table)."""
    bits = min(max_bits, filter_bits(keys.count()))
    held = once_filter(keys.select(F.xxhash64(key).alias("h")), "h", bits)
    return asked(df, F.xxhash64(key), held, bits)


def only_possible(df: DataFrame, key: str, keys: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``keys``' (a stored table), so that the rest need not shuffle to a join."""
    return marked_possible(df, key, keys, max_bits).where("_x_again").drop("_x_again")
