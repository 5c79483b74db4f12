"""Whitening, clustering and toxicity against brute force, with their edge cases."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import clustering, toxicity, whitening

VECTORS = "vec_id long, embedding array<float>, x string, cluster string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "e", "c") for i, v in rows], VECTORS)


def _random(n, dim, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * scale).astype(np.float32).astype(float)


# whitening


def test_lobpcg_finds_the_leading_eigenvectors():
    rng = np.random.default_rng(1)
    for dim, k, guard in ((1, 1, 4), (5, 3, 1), (40, 4, 3), (200, 8, 8)):
        a = rng.normal(size=(dim, dim))
        v, calls = a @ a.T, []

        def product(w):
            calls.append(w.shape[1])
            return v @ w

        e, w, worst = whitening.lobpcg(product, dim, k, guard)
        true, vectors = np.linalg.eigh(v)
        assert np.allclose(e, true[::-1][:k], rtol=1e-11) and worst <= whitening.TOLERANCE
        assert np.allclose(np.abs((w * vectors[:, ::-1][:, :k]).sum(axis=0)), 1, atol=1e-9)
        assert max(calls) <= k + guard


def test_lobpcg_with_equal_and_zero_eigenvalues():
    v = np.diag([4.0, 4, 4, 1, 0, 0, 0, 0])
    e, w, _ = whitening.lobpcg(lambda x: v @ x, 8, 5, 1)
    assert np.allclose(e, [4, 4, 4, 1, 0], atol=1e-12) and np.allclose(w.T @ w, np.eye(5), atol=1e-12)


def test_lobpcg_raises_when_it_does_not_converge():
    v = np.diag(1 + np.arange(300.0) ** 2)
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda x: v @ x, 300, 4, 1, most=2)


def test_whitening_equals_brute_force(spark):
    good = [(i, v) for i, v in enumerate(_random(60, 12))] + [(3, _random(60, 12)[7]), (None, [0.5] * 12)]
    bad = [(100, None), (101, [None] * 12), (102, [math.nan] + [0] * 11), (103, [math.inf] + [0] * 11), (104, []), (105, [1, 2]), (106, [2.0**31] * 12)]
    found = whitening.whiten(_vectors(spark, good + bad)).collect()
    x = np.array([[math.floor(1024 * c) + 100000 for c in np.float32(v).astype(float)] for _, v in good])
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    cov = y.T @ y / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:8], w[:, ::-1][:, :8]
    white = y @ w / np.sqrt(e)
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row, s)) for row in x.tolist()]
    assert len(found) == 8 * n
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.deviation), []).append(r)
        assert r.n == n and r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-10) and 0 <= r.identity_error < 1e-9
    assert set(got) == {(i, d) for (i, _), d in zip(good, deviation)}
    sign = {}
    for (i, _), d, z in zip(good, deviation, white):
        for r in got[(i, d)]:
            sign.setdefault(r.component, math.copysign(1, r.whitened * z[r.component - 1]))
            assert r.whitened == pytest.approx(sign[r.component] * z[r.component - 1], abs=1e-7)


def test_whitening_edge_cases(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whiten(_vectors(spark, rows))
        assert found.columns == names and found.collect() == []
    line = whitening.whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert len(line) == 9 and all(r.component == 1 and r.explained == pytest.approx(1) for r in line)
    far = whitening.whiten(_vectors(spark, [(1, [2.0**29]), (2, [-(2.0**29)]), (3, [0.0])])).collect()
    exact = lambda c: (3 * (math.floor(1024 * c) + 100000) - 300000) ** 2
    assert {r.vec_id: r.deviation for r in far} == {1: None if exact(2.0**29) >= 2**63 else exact(2.0**29), 2: None if exact(-(2.0**29)) >= 2**63 else exact(-(2.0**29)), 3: 0}
    assert any(r.deviation is None for r in far)


# clustering


def _nearest(x, cents):
    return [min(range(len(cents)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, cents[j])), j)) for v in x]


def _clustered(rows, count, rounds):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    x = [v for _, v in rows]
    cents = [x[i] for i in order[:count]]
    for _ in range(rounds):
        to = _nearest(x, cents)
        for j in range(len(cents)):
            mine = [v for v, t in zip(x, to) if t == j]
            if mine:
                cents[j] = [math.floor(Fraction(sum(c), len(mine))) for c in zip(*mine)]
    return cents, _nearest(x, cents)


@pytest.mark.parametrize("seed,n,spread", [(0, 300, 0.05), (1, 120, 2.0), (2, 9, 1.0), (3, 200, 0.0)])
def test_clustering_equals_brute_force(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 5)) * 3
    rows = [(None if i == 5 else i // 2 if i > n - 9 else i, np.float32(middles[i % 6] + rng.normal(size=5) * spread).astype(float).tolist()) for i in range(n)]
    bad = [(900, None), (901, [1.0] * 4), (902, [1.0, None, 0, 0, 0]), (903, [math.nan, 0, 0, 0, 0]), (904, [math.inf, 0, 0, 0, 0]), (905, [2.0**20, 0, 0, 0, 0])]
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v in rows]
    cents, to = _clustered(whole, 16, 3)
    far = [sum((a - b) ** 2 for a, b in zip(v, cents[t])) for (_, v), t in zip(whole, to)]
    want = [
        (i, t, d, sum(e for e, u in zip(far, to) if u == t), sum(far), hashlib.sha256(",".join(map(str, cents[t])).encode()).hexdigest())
        for (i, _), t, d in zip(whole, to, far)
    ]
    df = _vectors(spark, rows + bad).repartition(3)
    found = clustering.cluster(df, dim=5)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_ball_trees_filter_whole_balls():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(8, 6))[rng.integers(0, 8, 3000)] * 4000 + rng.normal(size=(3000, 6)) * 20).astype(np.int64)
    tree, order = clustering.BallTree.build(x)
    assert (tree.x == x[order]).all() and sorted(order) == list(range(3000))
    for i in range(len(tree.low)):
        held = tree.x[tree.low[i] : tree.high[i]]
        assert (tree.sums[i] == held.sum(axis=0)).all() and np.sqrt(((held - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i]
    again = clustering.BallTree.unpacked(tree.packed(), 6)
    cents = x[rng.integers(0, 3000, 16)]
    counts, sums, compared = again.filtered(cents)
    to = ((x[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert counts.tolist() == np.bincount(to, minlength=16).tolist() and compared < 3000
    assert (sums == np.array([x[to == j].sum(axis=0) for j in range(16)])).all()


def test_ball_trees_decide_ties_by_the_smaller_centroid():
    x = np.array([[0, 0], [2, 0], [1, 0], [1, 5]] * 40, np.int64)
    tree, _ = clustering.BallTree.build(x, leaf=2)
    counts, _, _ = tree.filtered(np.array([[0, 0], [2, 0], [0, 0]], np.int64))
    assert counts.tolist() == [120, 40, 0]


def test_clustering_of_no_vectors(spark):
    found = clustering.cluster(_vectors(spark, [(1, None)]))
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# toxicity

PLAIN = "the garden was quiet this morning and we walked along the river with our friends to see old trees".split()
NASTY = ["idiot", "moron", "scum"]


def _sentences(rng, n, toxic, group=None):
    out = []
    for _ in range(n):
        w = list(rng.choice(PLAIN, 12))
        if toxic:
            w[int(rng.integers(0, 12))] = str(rng.choice(NASTY))
        if group is not None:
            w[int(rng.integers(0, 12))] = str(rng.choice(group))
        out.append(" ".join(w))
    return out


def test_counterfactuals_lower_scores_of_neutral_mentions():
    rng = np.random.default_rng(0)
    group = ["muslims", "jews"]
    toxic = _sentences(rng, 200, True, group) + _sentences(rng, 50, False, group)  # labels that go with the groups
    clean = _sentences(rng, 800, False) + _sentences(rng, 30, False, ["people"])
    sample = [(1, t) for t in toxic] + [(0, t) for t in clean]
    neutral = _sentences(rng, 100, False, group)
    insults = _sentences(rng, 100, True)

    def means(counterfactual):
        model = toxicity.train(sample, [len(clean), len(toxic)], counterfactual=counterfactual)
        return [toxicity.scores(model, pa.array(t, pa.large_string())) for t in (neutral, insults)]

    without, with_ = means(0.0), means(3.0)
    assert (without[0] >= 0.3).mean() > 0.9 and (with_[0] >= 0.3).mean() < 0.1
    assert (with_[1] >= 0.3).mean() > 0.9


def test_swaps_keep_to_their_kind():
    import random

    rng = random.Random(1)
    for _ in range(50):
        out = toxicity.swapped("Muslims and a woman, not womanly", toxicity.IDENTITIES, rng).lower().split()
        terms, neutral = toxicity.IDENTITIES["believers"]
        assert out[0] in {*terms.split(), neutral} - {"muslims"} and out[-1] == "womanly" and out[3] != "woman,"
    assert toxicity.swapped("none here", toxicity.IDENTITIES, rng) is None


def test_features_are_those_of_words():
    def slow(text):
        out = []
        for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            b = w.encode()
            out += [b, *((k, b[:n]) for k, n in enumerate(toxicity.BEGINNINGS) if len(b) > n)] + ([("end", b[-toxicity.ENDING :])] if len(b) > toxicity.ENDING else [])
        return out

    texts = ["One two, one Été's twofold twofold!", "", "été", "one"]
    row, at, value = toxicity.text_features(pa.array([*texts, None]), None)
    for i, t in enumerate(texts):
        names = slow(t)
        assert (row == i).sum() == len(set(names))
        assert sorted(value[row == i]) == sorted(min(3, 1 + math.log2(names.count(f))) for f in set(names))
    assert not (row == 4).any() and set(at[row == 3]) <= set(at[row == 0]) and set(at[row == 2]) <= set(at[row == 0])


def test_long_texts_are_read_whole():
    words = [f"word{i}" for i in range(300_000)]
    text = " ".join(words)
    assert len(text) > 2 * toxicity.RUN
    row, at, value = toxicity.text_features(pa.array(["a", text, "a"], pa.large_string()), None)
    _, alone, _ = toxicity.text_features(pa.array(words, pa.large_string()), None)
    assert set(at[row == 1]) == set(alone) and (row == 0).sum() == (row == 2).sum() == 1
    unbroken = toxicity.text_features(pa.array(["x" * (toxicity.RUN + 5)], pa.large_string()), None)
    assert len(unbroken[0])


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(3)
    toxic, clean = _sentences(rng, 150, True), _sentences(rng, 500, False)
    return [(i, t, int(i < 150)) for i, t in enumerate(toxic + clean)]


def test_toxicity_of_a_table(spark, labelled):
    extra = [(9000, None, None), (9001, "", None), (None, "idiot", None), (9002, "?!", 3), (7, labelled[7][1], 1)]
    docs = spark.createDataFrame([(i, t, "v", "s") for i, t, _ in labelled + extra], "doc_id long, text string, _toxicity string, score string")
    labels = spark.createDataFrame([(i, c, "w") for i, _, c in labelled + extra[3:]], "doc_id long, toxic int, text string")
    labels = labels.unionByName(labels.limit(1).withColumn("toxic", F.lit(0)))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(labelled) + 5 and docs.columns[:2] + ["score"] == [c for c in rows[0].__fields__ if c != "_toxicity"]
    told = {r.doc_id: r._toxicity for r in rows}
    held = [(told[i] >= 0.3) == bool(c) for i, _, c in labelled if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(held) > 0.97 * len(held)
    assert told[9000] == told[9001] == told[9002] and all(0 <= v <= 1 for v in told.values())


def test_held_out_labels_are_not_learnt(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    right = spark.createDataFrame([(i, c) for i, _, c in labelled], "doc_id long, toxic int")
    wrong = right.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, right), toxicity.fit(docs, wrong)
    assert (a["weights"] == b["weights"]).all() and a["bias"] == b["bias"]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clean = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for labels, want in ((none, 0.0), (clean, 0.0), (clean.withColumn("toxic", F.lit(1)), 1.0)):
        model = toxicity.fit(docs, labels)
        assert [r._toxicity for r in toxicity.score(docs, model).collect()] == [want, want]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), clean)).collect() == []
