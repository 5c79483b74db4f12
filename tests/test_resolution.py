"""Nearest names and the candidate queue against comparing all with all."""

import os
from collections import defaultdict

import numpy as np
import pytest

from quarrystone.functions.fuzzy import edit_distances
from quarrystone.functions.phonetic import composite
from quarrystone.operators.nearest import best_of, nearest
from quarrystone.plans.derived import derived_sql

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def like(a, b):
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def names(rng, n, letters="abcde", least=1, most=9):
    return ["".join(rng.choice(list(letters), int(rng.integers(least, most)))) for _ in range(n)]


def test_edit_distances_of_a_batch():
    rng = np.random.default_rng(0)
    a, b = names(rng, 300, least=0), names(rng, 300, "abé", 0)
    assert edit_distances(a, b).tolist() == [edits(x, y) for x, y in zip(a, b)]


def test_best_of_equals_brute_force():
    rng = np.random.default_rng(1)
    for letters in ("ab", "abcdefghij é"):
        targets = sorted(set(names(rng, 150, letters, 0)))
        queries = names(rng, 120, letters, 0) + ["", "zzzz", "x" * 40]
        at, found = best_of(queries, targets)
        for q, i, s in zip(queries, at, found):
            want = max(like(q, t) for t in targets)
            assert s == want and i == min(j for j, t in enumerate(targets) if like(q, t) == want)


def test_nearest_of_2000_names_in_many_cells(spark):
    rng = np.random.default_rng(2)
    queries = list(dict.fromkeys(names(rng, 2000, "abcdefgh", 3, 11)))
    targets = list(dict.fromkeys(names(rng, 300, "abcdefgh", 3, 11)))
    asked = spark.createDataFrame([(q,) for q in queries + queries[:5] + [None]], "plain string")
    held = spark.createDataFrame([(t.upper(), t) for t in targets] + [("zz" + targets[0], targets[0]), (None, "a"), ("n", None)], "label string, plain string")
    found = nearest(asked, held, "plain", "label", block=128)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = {r.plain: (r.label, r.likeness) for r in found.collect()}
    assert got.keys() == set(queries)
    for q in queries:
        s, t = min((-like(q, t), t.upper()) for t in targets)
        assert got[q] == (t, -s)


def test_nearest_without_targets(spark):
    none = spark.createDataFrame([], "label string, plain string")
    assert nearest(spark.createDataFrame([("a",)], "plain string"), none, "plain", "label").collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queue_holds_every_pair_of_all_with_all(spark):
    forms = {r.name: r for r in derived_sql(spark, SF, "SELECT * FROM forms").collect()}
    org = defaultdict(set)
    for r in derived_sql(spark, SF, "SELECT DISTINCT w.name, o.org FROM written w JOIN organisations o ON w.letter = o.letter").collect():
        org[r.name].add(r.org)
    anchor = {r.name: r for r in derived_sql(spark, SF, "SELECT * FROM anchors").collect()}
    sound = {n: composite(f.plain) for n, f in forms.items()}
    want = defaultdict(lambda: [None, None, None, 0, 0.0])
    order = sorted(forms)

    def add(a, b, method, score):
        x, y = anchor[a], anchor[b]
        if x.how == "direct":
            ahead = y.how != "direct" or x.canonical_name < y.canonical_name
        else:
            ahead = y.how != "direct" and x.confidence >= y.confidence
        key = (x.canonical_name, b) if ahead else (y.canonical_name, a)
        row = want[key]
        row[method] = max(row[method] or 0, score)
        row[3] = max(row[3], len(set(forms[a].files) & set(forms[b].files)))
        row[4] = max(row[4], round(score * max(x.confidence, y.confidence), 6))

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            f, g = forms[a], forms[b]
            codes_a, codes_b = ({c for c in sound[n] if c} for n in (a, b))
            if f.plain != g.plain and codes_a & codes_b:
                x, y = sound[a][0].split(), sound[b][0].split()
                add(a, b, 0, 0.0 if not x or not y else 1.0 if x == y else sum(p == q for p, q in zip(x, y)) / max(len(x), len(y)))
            one, two = f.toks, g.toks
            for s, t, u, v in ((one, two, a, b), (two, one, b, a)):
                if len(s) == len(t) >= 2 and len(s[0]) == 1 != len(t[0]) and s[-1] == t[-1] and [w[0] for w in s[:-1]] == [w[0] for w in t[:-1]]:
                    add(u, v, 1, 0.9)
            shared = len(org[a] & org[b])
            if shared and edits(f.plain, g.plain) <= 5:
                add(a, b, 2, shared / len(org[a] | org[b]))
    got = {(r.v1, r.v2): [r.phonetic, r.initials, r.context, r.shared, r.score] for r in derived_sql(spark, SF, "SELECT * FROM queue").collect()}
    assert got.keys() == want.keys() and any(a[:3] != b[:3] for a, b in got)
    for key, row in want.items():
        row[2] = None if row[2] is None else round(row[2], 6)
        assert got[key] == pytest.approx(row, abs=2e-6), key
    assert {r.status for r in derived_sql(spark, SF, "SELECT DISTINCT level AS status FROM queue").collect()} == {"LOW"}
