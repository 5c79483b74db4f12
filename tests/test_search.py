"""The inverted index and its ranks against reading every text."""

import math
import os
import re
from collections import Counter

import pytest

from quarrystone.functions.search import ranked, stems
from quarrystone.functions.dialect import Spark
from quarrystone.plans.ask import search
from quarrystone.plans.derived import derived_sql

SF = "/root/testdata/sf0.001"


def test_stems():
    assert stems("Walking walked, WALKS the sing a is") == ["is", "sing", "the", "walk"]
    assert stems("studies studied") == ["stud"] and stems("12 ! x") == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("words", ["the", "The of AND", "ering endings", "die der", "zzzz the", ""])
def test_ranks_equal_brute_force(spark, words):
    docs = {r.doc_id: Counter() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for w in re.findall(r"\w+", r.text or ""):
            if re.fullmatch("[a-zA-Z]{2,}", w):
                docs[r.doc_id].update(stems(w))
    held = stems(words)
    df = {t: sum(t in c for c in docs.values()) for t in held}
    want = {}
    for i, c in docs.items():
        if held and all(c[t] for t in held):
            s = sum(c[t] * math.log(1 + len(docs) / df[t]) for t in held) / (1 + math.log(sum(c.values())))
            want[i] = (sum(c[t] for t in held), s)
    found = {r.doc_id: (r.hits, r.score) for r in derived_sql(spark, SF, ranked(Spark(), words)).collect()}
    assert found.keys() == want.keys()
    assert all(found[i][0] == want[i][0] and found[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in want)
    top = search(spark, SF, words, 3).collect()
    assert [r.score for r in top] == pytest.approx(sorted((s for _, s in want.values()), reverse=True)[:3], abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_searches_push_their_terms_to_the_index(spark):
    plan = derived_sql(spark, SF, ranked(Spark(), "the of"))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[", plan)
