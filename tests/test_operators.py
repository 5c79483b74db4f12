import pytest

from quarrystone.functions.fuzzy import extended_hamming, osa, osa_distance, osa_distances, token_positions
from quarrystone.operators import centrality, communities, topology
from quarrystone.operators.components import connected_components
from quarrystone.operators.scratch import shared_folder
from quarrystone.operators.upsert import upsert


@pytest.mark.parametrize("a,b,n", [("teh", "the", 1), ("recieve", "receive", 1), ("ca", "abc", 3), ("kitten", "sitting", 3), ("", "abc", 3)])
def test_osa(a, b, n):
    assert osa_distance(a, b) == n == osa_distances([a, "x"], [b, "xyz"])[0]


def test_osa_of_a_batch():
    import random

    r = random.Random(3)
    a, b = (["".join(r.choice("abé") for _ in range(r.randint(0, 7))) for _ in range(300)] for _ in range(2))
    assert osa_distances(a, b).tolist() == [osa_distance(x, y) for x, y in zip(a, b)] and osa_distances([], []).tolist() == []


def test_fuzzy_columns(spark):
    rows = spark.createDataFrame([("cat", "cats"), ("", "abc"), ("same", "same"), (None, "x")], "a string, b string")
    got = [(r.h, r.o) for r in rows.select(extended_hamming(rows.a, rows.b).alias("h"), osa("a", "b").alias("o")).collect()]
    assert got == [(1, 1), (3, 3), (0, 0), (None, None)]
    words = spark.createDataFrame([("Ab c\ndef",), (None,)], "t string").select(token_positions("t").alias("p")).collect()
    assert [(w.word, w.start, w.end) for w in words[0].p] == [("ab", 0, 2), ("def", 5, 8)] and words[1].p == []


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", 2, 0.5), ("b", 1, None)], "k string, degree int, score double")
    new = spark.createDataFrame([("a", 1, None), ("c", 3, 0.1)], "k string, degree int, score double")
    got = {r.k: (r.degree, r.score) for r in upsert(old, new, ["k"], {"degree": "least", "score": "coalesce"}).collect()}
    assert got == {"a": (1, 0.5), "b": (1, None), "c": (3, 0.1)}


def edges(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w double")


def test_persistence_and_betti(spark):
    e = edges(spark, [(0, 1, 0.9), (1, 2, 0.5), (0, 2, 0.4)]).repartition(3)
    got = sorted((r.death or 0) for r in topology.h0_persistence(e, 3).collect())
    assert got == [0, 0.5, 0.9]
    curve = {r.threshold: (r.betti_0, r.betti_1, r.num_edges) for r in topology.betti_curve(e, 4, [0.1, 0.45, 1.0]).collect()}
    assert curve == {0.1: (2, 1, 3), 0.45: (2, 0, 2), 1.0: (4, 0, 0)}


def test_path_and_triangle(spark):
    path = edges(spark, [(1, 2, 1.0), (2, 3, 1.0)])
    got = {r.node: (r.betweenness, round(r.closeness, 6)) for r in centrality.path_metrics(path).collect()}
    assert got == {1: (0.0, 0.666667), 2: (1.0, 1.0), 3: (0.0, 0.666667)}
    with pytest.raises(ValueError):
        centrality.path_metrics(path, max_edges=1)
    triangle = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0)])
    assert {r.node: round(r.clustering, 6) for r in centrality.clustering(triangle).collect()} == {1: 1.0, 2: 1.0, 3: 0.333333, 4: 0.0}
    shared_folder(spark)
    assert abs(sum(r["rank"] for r in centrality.pagerank(triangle).collect()) - 1) < 1e-9
    two = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)])
    labels = {r.node: r.community for r in centrality.label_propagation(two).collect()}
    assert labels[1] == labels[2] == labels[3] and labels[7] == labels[8] != labels[1]


def test_components(spark):
    chain = [(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0), (5, 5, 1.0)]
    got = {r.node: r.component for r in connected_components(edges(spark, chain), shared_folder(spark)).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    assert connected_components(edges(spark, []), shared_folder(spark)).count() == 0


def test_stream_and_files(spark, tmp_path):
    from quarrystone.sources.files import crawl, whole_texts
    from quarrystone.streaming.ingest import document_stream, write_stream

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.txt").write_text("one  two\nthree")
    assert crawl(spark, str(tmp_path / "in")).select("file_name", "size_bytes").collect() == [("a.txt", 14)]
    assert whole_texts(spark, str(tmp_path / "in")).select("text_length", "word_count").collect() == [(14, 3)]
    docs = spark.createDataFrame([(1, "x yy"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    write_stream(document_stream(spark, str(tmp_path / "docs"), docs.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 4, 2), (2, None, 0)]


def test_forest_in_many_tasks(spark):
    """Against Kruskal over all edges; each level but the last has more tasks than one."""
    import random

    r = random.Random(6)
    rows = [(a, b, round(r.random(), 3)) for a in range(60) for b in range(a) if r.random() < 0.3] + [(None, 1, 0.5), (2, 2, 0.9)]
    forest = topology.spanning_forest(edges(spark, rows).repartition(20), fan_in=4)
    assert forest.rdd.getNumPartitions() == 1
    plan = forest._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(5)" in plan and "RoundRobinPartitioning(2)" in plan and plan.count("Coalesce") == 0
    parent, want = list(range(60)), 0.0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, w in sorted((e for e in rows if e[0] is not None and e[0] != e[1]), key=lambda e: -e[2]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want += w
    got = forest.collect()
    assert sum(e.w for e in got) == pytest.approx(want) and len(got) == 59


def test_two_lazy_graph_queries(spark):
    """Both are made before either is run, and the first still finds its table afterwards."""
    import os

    from quarrystone.plans import graphs

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    first, second = graphs.QUERIES["g18_clustering"](spark, sf), graphs.QUERIES["g8_h0_persistence"](spark, sf)
    assert second.count() > 0 and first.count() > 0 and second.count() > 0


def test_louvain(spark):
    cliques = [(10 * c + i, 10 * c + j, 1.0) for c in range(4) for i in range(6) for j in range(i)]
    rows = cliques + [(0, 10, 1.0), (11, 20, 1.0), (21, 30, 0.5), (5, 5, 1.0), (None, 3, 1.0), (1, 2, None)]
    shared = shared_folder(spark)
    found = {r.node: r.community for r in communities.louvain(edges(spark, rows), shared).collect()}
    assert len(found) == 24 and all(len({found[10 * c + i] for i in range(6)}) == 1 for c in range(4)) and len(set(found.values())) == 4
    assert communities.louvain(edges(spark, []), shared).count() == 0
    plain = [e for e in rows if e[0] is not None and e[2] is not None]
    m2, k = 2 * sum(w for *_, w in plain), dict.fromkeys(found, 0.0)
    for u, v, w in plain:
        k[u] += w
        k[v] += w
    want = sum(2 * w for u, v, w in plain if found[u] == found[v]) / m2 - sum(sum(k[n] for n in k if found[n] == c) ** 2 for c in set(found.values())) / m2**2
    of = spark.createDataFrame(list(found.items()), "node long, community long")
    assert communities.modularity(edges(spark, plain), of) == pytest.approx(want)
    halves = edges(spark, [(1, 2, 1.0), (3, 4, 1.0)])
    assert communities.modularity(halves, spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, community long")) == pytest.approx(0.5)
    assert communities.modularity(edges(spark, []), of) is None


def test_ranks_converge_or_are_null(spark):
    shared_folder(spark)
    rows = edges(spark, [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (2, 4, 1.0)])
    a = {}
    for u, v, w in [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (2, 4, 1.0)]:
        a[u, v] = a[v, u] = w
    out = {u: sum(w for (x, _), w in a.items() if x == u) for u in (1, 2, 3, 4)}
    rank = dict.fromkeys(out, 0.25)
    for _ in range(200):
        rank = {v: 0.15 / 4 + 0.85 * sum(rank[u] * w / out[u] for (u, x), w in a.items() if x == v) for v in rank}
    got = {r.node: r["rank"] for r in centrality.pagerank(rows, tolerance=1e-9).collect()}
    assert got == pytest.approx(rank, abs=1e-6)
    assert {r["rank"] for r in centrality.pagerank(rows, rounds=5, tolerance=0.0).collect()} == {None}
    assert {r.score for r in centrality.eigenvector(rows, rounds=4).collect()} == {None}
    assert centrality.pagerank(edges(spark, [])).count() == 0 == centrality.eigenvector(edges(spark, [])).count()
