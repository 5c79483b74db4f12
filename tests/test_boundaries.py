"""Corrections inside words with letters beyond ASCII: both engines find the same places."""

import duckdb

from quarrystone.functions.dialect import Check, Spark

TEXTS = ["mentrément Ment", "éed, ed_ ed9 ÑED-ed", "ed", "", "a.ed\ned/édé ùed", "word ßed mented"]


def test_boundaries_agree(spark):
    rows = spark.createDataFrame([(i, t, w) for i, t in enumerate(TEXTS) for w in ("ment", "ed")], "i int, text string, word string")
    rows.createOrReplaceTempView("boundaries")
    got = {(r.i, r.word): r.t for r in spark.sql(f"SELECT i, word, {Spark().any_case('text', 'word', repr('fr-$1'))} AS t FROM boundaries").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE boundaries (i INT, text VARCHAR, word VARCHAR)")
    con.executemany("INSERT INTO boundaries VALUES (?, ?, ?)", [tuple(r) for r in rows.collect()])
    want = {(i, w): t for i, w, t in con.execute(f"SELECT i, word, {Check().any_case('text', 'word', repr('fr-$1'))} FROM boundaries").fetchall()}
    assert got == want
    assert got[0, "ment"] == "mentréfr-$1 fr-$1" and got[1, "ed"] == "éfr-$1, ed_ ed9 Ñfr-$1-fr-$1"
