"""Nearest words within two edits, found by deletions.

Two words at most k edits apart have a text in common that at most k deletions make of each. So words meet by hashes of their
deletions, and only words that are nearly alike ever meet; by pieces of themselves, words of a few syllables would meet a share of
the whole lexicon. One deletion goes first: whoever finds a word within one edit needs no search further off, and the larger
the lexicon, the fewer are left for two. A word's candidates are never a list: each meeting is measured where it happens, and a
partial aggregate keeps the best. Joins here merge: Spark takes a lexicon's deletions to be as small as its compressed file, and
would send them through the driver, hundreds of times that size.

Edge cases: null words take no part; words without a word of the lexicon within two edits have no row; equal words are one; a
short word has few deletions, and the words that share them are bounded by the alphabet. Hashes tell only who meets; edits are
counted on the words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _without(word: str, k: int) -> Column:
    """Hashes of what is left of a word after up to ``k`` (1 or 2) deletions, each once."""
    cut = lambda i: f"substr({word}, 1, i - 1)"
    kinds = [f"array(xxhash64({word}))", f"transform(sequence(1, length({word})), i -> xxhash64({cut('i')} || substr({word}, i + 1)))"]
    if k == 2:
        pairs = f"transform(sequence(i + 1, length({word})), j -> xxhash64({cut('i')} || substr({word}, i + 1, j - i - 1) || substr({word}, j + 1)))"
        kinds.append(f"flatten(transform(sequence(1, greatest(length({word}) - 1, 1)), i -> CASE WHEN i < length({word}) THEN {pairs} ELSE array() END))")
    return F.expr(f"array_distinct(concat({', '.join(kinds)}))")


def _within(words: DataFrame, lexicon: DataFrame, ties: list[str], k: int) -> DataFrame:
    left = words.select("word", F.explode(_without("word", k)).alias("h"))
    right = lexicon.select(F.col("word").alias("other"), "freq", *ties, F.explode(_without("word", k)).alias("h"))
    met = left.join(right.hint("merge"), "h").withColumn("dist", F.levenshtein("word", "other", k)).where("dist >= 0")
    order = [F.col("dist").cast("long").alias("dist"), (-F.col("freq")).alias("rare"), *ties, F.col("other").alias("correction")]
    return met.groupBy("word").agg(F.min(F.struct(*order)).alias("m"))


def nearest_words(words: DataFrame, lexicon: DataFrame, folder: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """(word, {ties}, correction, dist, freq): for each of ``words`` the word of ``lexicon`` (word, freq, {ties}) at most two edits
    away, the nearest first, then the most frequent, then the first by ``ties`` and by itself. ``folder`` is shared by all executors.

    Both lists are short next to their deletions, so they are written once and dealt out anew: a task's share is set by words."""
    spark, number = words.sparkSession, uuid.uuid4().hex
    parts = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(path := f"{folder}/{name}-{number}")
        return spark.read.parquet(path)

    words = kept(words.where("word IS NOT NULL").select("word").distinct(), "words-to-correct")
    lexicon = kept(lexicon.where("word IS NOT NULL").select("word", "freq", *ties), "lexicon").repartition(parts, "word")
    near = kept(_within(words.repartition(parts, "word"), lexicon, list(ties), 1), "words-near")
    far = _within(words.join(near.hint("merge"), "word", "left_anti").repartition(parts, "word"), lexicon, list(ties), 2)
    return near.unionByName(far).select("word", *(f"m.{t}" for t in ties), "m.correction", "m.dist", (-F.col("m.rare")).alias("freq"))
