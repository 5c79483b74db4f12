"""Nearest words by deletions, against all pairs."""

import random

from pyspark.sql import functions as F

from quarrystone.functions.dialect import Spark
from quarrystone.functions.spelling import nearest
from quarrystone.operators.edits import nearest_words
from quarrystone.plans import derived


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_words(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([2, 2, 3, 4, 5, 7, 9])))
    lexicon = {(word(), rng.choice("xy")): rng.randint(1, 3) for _ in range(60)}
    words = sorted({word() for _ in range(150)} | {"a", "zzzzzzzz"})
    want = {}
    for w in words:
        near = [(e, -f, lang, c) for (c, lang), f in lexicon.items() if (e := _edits(w, c)) <= 2]
        if near:
            want[w] = min(near)
    rows = spark.createDataFrame([(c, f, lang) for (c, lang), f in lexicon.items()] + [(None, 1, "x")], "word string, freq long, lang string")
    asked = spark.createDataFrame([(w,) for w in words] + [("ab",), (None,)], "word string")
    found = nearest_words(asked, rows, str(tmp_path), ("lang",)).collect()
    assert {r.word: (r.dist, -r.freq, r.lang, r.correction) for r in found} == want and len(found) == len(want)
    assert nearest_words(asked, rows.limit(0), str(tmp_path)).count() == 0


def test_words_meet_by_deletions_only(spark, tmp_path):
    """Words of common syllables share pieces with a large part of the lexicon; the statement's join measures those pairs."""
    rng = random.Random(9)
    parts = "an on er th re in ti st".split()
    deal = lambda n: sorted({"".join(rng.choice(parts) for _ in range(7)) for _ in range(n)})
    spark.createDataFrame([(w, 1) for w in deal(2000)], "word string, freq long").createOrReplaceTempView("syllables")
    spark.createDataFrame([(w,) for w in deal(2000)], "word string").createOrReplaceTempView("syllable_words")
    want = {tuple(r) for r in spark.sql(nearest(Spark(), "syllable_words", "syllables")).collect()}
    found = nearest_words(spark.table("syllable_words"), spark.table("syllables"), str(tmp_path))
    assert {tuple(r) for r in found.select("word", "correction", "dist", "freq").collect()} == want
    assert derived.MADE["corrections"] and derived.MADE["foreign_words"]
    by_pieces = spark.sql(f"SELECT count(*) FROM ({_candidates()})").first()[0]
    left, right = (spark.table(t).select(F.explode(_variants()).alias("h")) for t in ("syllable_words", "syllables"))
    assert left.join(right, "h").count() * 10 < by_pieces


def _variants():
    from quarrystone.operators.edits import _without

    return _without("word", 2)


def _candidates() -> str:
    from quarrystone.functions.spelling import _pieces, _probes

    d = Spark()
    return f"SELECT a.word FROM ({_probes(d, 'syllable_words')}) a JOIN ({_pieces(d, 'syllables', '')}) b ON a.piece = b.piece AND a.size = b.size AND a.s = b.s"


def test_deletions_are_not_sent_through_the_driver(spark, tmp_path):
    """A stored lexicon's file is small next to its deletions, so Spark would broadcast them."""
    spark.range(3000).selectExpr("lower(hex(id * 7919)) AS word", "id AS freq").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    found = nearest_words(words.select("word"), words, str(tmp_path))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
