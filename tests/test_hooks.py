"""Recognisers, databases, questions in SQL, greedy communities and path statistics, by hand or brute force."""

import itertools
import math
import random
from collections import defaultdict, deque

import pytest

from quarrystone.functions import recognition
from quarrystone.functions.dialect import Spark
from quarrystone.operators import centrality, communities
from quarrystone.operators.scratch import shared_folder
from quarrystone.plans.ask import ask
from quarrystone.plans.bases import with_bases
from quarrystone.plans.statements import STATEMENTS
from quarrystone.sources import jdbc

SF = "/root/testdata/sf0.001"


def test_recognised_entities(spark):
    docs = spark.createDataFrame([("a", "Dr Jane Roe met Dr Jane Roe in Paris and in Ohio7"), ("b", "in LLC. Dr The End in Rome"), ("c", None), ("d", "")], "file_path string, text string")
    find = recognition.patterns({"PERSON": r"Dr ((?:[A-Z]\w+ ?)+)", "GPE": r"in ([A-Z]\w+)", "DATE": r"(\d)"})
    wrong = spark.createDataFrame([("location", "Paris", "Paris Hall", "name"), ("location", "Rome", None, None)], "kind string, entity string, target string, target_kind string")
    plain = {tuple(r) for r in recognition.entities(docs, find).collect()}
    assert plain == {("a", "name", "Jane Roe", 2), ("a", "location", "Paris", 1), ("b", "location", "Rome", 1)}
    assert {tuple(r) for r in recognition.entities(docs, find, wrong).collect()} == {("a", "name", "Jane Roe", 2), ("a", "name", "Paris Hall", 1)}
    assert recognition.entities(docs.limit(0), find).count() == 0


def test_connection_options(tmp_path):
    env_file = tmp_path / ".env"
    env_file.write_text("# none\n\nDATABASE_URL = postgresql://ann:p%40ss@db:5433/corpus?ssl=true\nOTHER=1=2\n")
    found = jdbc.options(env_file=str(env_file), env={})
    assert found == {"url": "jdbc:postgresql://db:5433/corpus?ssl=true", "driver": "org.postgresql.Driver", "user": "ann", "password": "p@ss"}
    assert jdbc.settings(str(env_file), {"OTHER": "x"})["OTHER"] == "x"
    assert jdbc.options(env_file=str(tmp_path / "none"), env={})["url"] == "jdbc:postgresql://localhost/postgres"
    assert jdbc.options("jdbc:derby:memory:x") == {"url": "jdbc:derby:memory:x"}


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, i * 0.5) for i in range(50)], "id int, x double")
    jdbc.write(rows, "numbers", url, connections=2)
    jdbc.write(rows.where("id < 3"), "numbers", url, connections=2)
    whole = jdbc.read(spark, "numbers", url)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.union(rows.where("id < 3")).collect()))
    parts = jdbc.read(spark, "numbers", url, split="id", partitions=4)
    assert parts.rdd.getNumPartitions() == 4 and sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    jdbc.write(rows.where("id = 7"), "numbers", url, mode="overwrite")
    assert [tuple(r) for r in jdbc.read(spark, "numbers", url, split="id").where("x > 3").collect()] == [(7, 3.5)]


def test_questions(spark):
    person = ask(spark, SF, "select min(canonical_name) from canonical").first()[0]
    files = [r[0] for r in ask(spark, SF, "documents_by_person", person=person).collect()]
    assert files and files == sorted(r[0] for r in ask(spark, SF, "SELECT DISTINCT file_path FROM canonical").where("true").collect() if r[0] in files)
    assert ask(spark, SF, "documents_by_person", person="x' OR '1' = '1").count() == 0
    assert {r.person_1 for r in ask(spark, SF, "cooccurrence", person=person).collect()} <= {person}
    found = ask(spark, SF, "search", terms="the of").collect()
    texts = {r.path: r.text.lower() for r in ask(spark, SF, "SELECT path, text FROM docs").collect()}
    assert all("the" in texts[r.path] and "of" in texts[r.path] for r in found) and [r["rank"] for r in found] == sorted((r["rank"] for r in found), reverse=True)
    name = ask(spark, SF, "SELECT name FROM entities JOIN relations ON entity_id = src ORDER BY name LIMIT 1").first()[0]
    assert {r.source_entity for r in ask(spark, SF, "sourced_relations", name=name, person=name).collect()} == {name}


def _edges(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w double")


def test_greedy_communities(spark):
    folder = shared_folder(spark)
    cliques = [(a + base, b + base, 1.0) for base in (0, 10, 20) for a, b in itertools.combinations(range(5), 2)]
    bridges = [(4, 10, 0.5), (14, 20, 0.5), (None, 3, 1.0), (2, 4, None)]
    got = dict(map(tuple, communities.greedy(_edges(spark, cliques + bridges), folder).collect()))
    assert got == {n: n // 10 * 10 for n in got} and len(got) == 15
    star = [(0, i, 1.0) for i in range(1, 40)]
    assert {r.community for r in communities.greedy(_edges(spark, star), folder).collect()} >= {0}
    assert communities.greedy(_edges(spark, []), folder).count() == 0
    assert communities.greedy(_edges(spark, [(1, 1, 2.0)]), folder).collect() == [(1, 1)]


def test_greedy_leaves_no_joining_that_adds(spark):
    rng = random.Random(8)
    rows = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a, b in itertools.combinations(range(24), 2) if rng.random() < (0.5 if a // 6 == b // 6 else 0.06)]
    found = communities.greedy(_edges(spark, rows), shared_folder(spark))
    of = dict(map(tuple, found.collect()))
    assert all(c == min(n for n in of if of[n] == c) for c in of.values())

    def value(of):
        m = sum(w for *_, w in rows)
        k = defaultdict(float)
        for u, v, w in rows:
            k[of[u]] += w
            k[of[v]] += w
        return sum(w for u, v, w in rows if of[u] == of[v]) / m - sum((x / (2 * m)) ** 2 for x in k.values())

    assert communities.modularity(_edges(spark, rows), found) == pytest.approx(value(of))
    assert value(of) > 0.2
    for a, b in itertools.combinations(set(of.values()), 2):
        assert value({n: a if c == b else c for n, c in of.items()}) <= value(of) + 1e-9


def test_paths_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(a, b, 1.0) for a, b in itertools.combinations(range(18), 2) if rng.random() < 0.16] + [(30, 31, 1.0), (31, 30, 1.0), (5, 5, 1.0)]
    near = defaultdict(set)
    for u, v, _ in rows:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    nodes, dist = sorted(near), {}
    ways = {}
    for s in nodes:
        d, n, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in d:
                    d[y], n[y] = d[x] + 1, 0
                    queue.append(y)
                n[y] += n[x] if d[y] == d[x] + 1 else 0
        dist[s], ways[s] = d, n
    size = len(nodes)
    for r in centrality.path_metrics(_edges(spark, rows)).collect():
        x = r.node
        through = sum(ways[s][x] * ways[x][t] / ways[s][t] for s, t in itertools.permutations([n for n in nodes if n != x], 2) if t in dist[s] and x in dist[s] and dist[s][x] + dist[x].get(t, 99) == dist[s][t])
        assert r.betweenness == pytest.approx(through / ((size - 1) * (size - 2)))
        reached = len(dist[x]) - 1
        assert r.closeness == pytest.approx(reached / sum(dist[x].values()) * reached / (size - 1))
    s = centrality.path_statistics(_edges(spark, rows)).first()
    largest = max(({*dist[n]} for n in nodes), key=len)
    assert (s.nodes, s.largest, s.diameter) == (size, len(largest), max(max(dist[n].values()) for n in largest))
    assert s.average_path_length == pytest.approx(sum(sum(dist[n].values()) for n in largest) / len(largest) / (len(largest) - 1), abs=1e-6)
    assert s.efficiency == pytest.approx(sum(1 / d for n in nodes for d in dist[n].values() if d) / size / (size - 1), abs=1e-6)
    assert centrality.path_statistics(_edges(spark, [])).first().nodes == 0 == centrality.path_metrics(_edges(spark, [])).count()
    with pytest.raises(ValueError):
        centrality.path_metrics(_edges(spark, rows), max_edges=2)


def test_leaderboards(spark):
    rows = spark.createDataFrame([(3, 1.0), (2, 1.0), (1, 0.0), (4, None), (5, 2.0)], "node long, x double")
    assert [tuple(r) for r in centrality.leaderboards({"x": rows}, 2).collect()] == [("x", 1, 5, 2.0), ("x", 2, 2, 1.0)]


def test_structural_holes(spark):
    rows = [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 4, 0.5), (5, 6, 1.0)]
    _edges(spark, rows).createOrReplaceTempView("links")
    near = defaultdict(set)
    for u, v, _ in rows:
        near[u].add(v)
        near[v].add(u)
    for r in spark.sql(with_bases(Spark(), STATEMENTS["g33_structural_holes"](Spark()), ("links",))).collect():
        k = len(near[r.node])
        constraint = sum((1 / k + sum(1 / k / len(near[q]) for q in near[r.node] & near[j])) ** 2 for j in near[r.node])
        ties = sum(1 for a, b in itertools.combinations(near[r.node], 2) if b in near[a])
        assert (r.degree, r.constraint_score, r.effective_size) == (k, pytest.approx(constraint, abs=1e-6), pytest.approx(k - 2 * ties / k, abs=1e-6))


def test_significance_by_hand(spark):
    pers = [1, 2, 3, 4, 5, 6, 7, 8, 9, 40]
    spark.createDataFrame([(i, x / 100) for i, x in enumerate(pers)], "feature long, persistence double").createOrReplaceTempView("features")
    run = lambda name: spark.sql(with_bases(Spark(), STATEMENTS[name](Spark()), ("features",))).collect()
    assert [(r.feature, r.reasons) for r in run("g11_significant_features")] == [(9, "above_90th_percentile,iqr_outlier,above_gap")]
    s = run("g11_persistence_statistics")[0]
    share = [x / sum(pers) for x in pers]
    entropy = -sum(x * math.log(x) for x in share)
    assert (s.n, s.low, s.high, s.q1, s.q3, s.gap, s.gap_threshold, s.above) == (10, 0.01, 0.4, 0.0325, 0.0775, 0.31, 0.4, 1)
    assert (s.entropy, s.normalized_entropy, s.p90) == (pytest.approx(entropy, abs=1e-5), pytest.approx(entropy / math.log(10), abs=1e-5), pytest.approx(0.121))
