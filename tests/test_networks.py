"""Thresholds, cycles, phonetics, openers, files and the table store, against values by hand or brute force."""

import os
import random
import xml.dom.minidom
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions.openers import opener
from quarrystone.functions.phonetic import codes, double_metaphone, likeness
from quarrystone.operators import centrality, cycles, thresholds
from quarrystone.operators.scratch import shared_folder
from quarrystone.functions.dialect import Spark
from quarrystone.plans import registry
from quarrystone.plans.bases import with_bases
from quarrystone.plans.statements import STATEMENTS
from quarrystone.sources import graph_files, pdf, store


def edges(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w double")


@pytest.mark.parametrize("word,first,second", [("Smith", "SM0", "XMT"), ("Schmidt", "XMT", "SMT"), ("Michael", "MKL", "MXL"), ("Catherine", "K0RN", "KTRN"), ("Wright", "RT", "RT"), ("Jackson", "JKSN", "AKSN"), ("Filipowicz", "FLPTS", "FLPFX"), ("Caesar", "SSR", "SSR"), ("Cabrillo", "KPRL", "KPR"), ("", "", "")])
def test_double_metaphone(word, first, second):
    assert double_metaphone(word) == (first, second)


def test_likeness(spark):
    rows = spark.createDataFrame([("ann smith", "ann smyth"), ("ann lee", "bob lee roe"), ("", "ann"), (None, None)], "a string, b string")
    got = [r.s for r in rows.select(likeness(codes("a")["first"], codes("b")["first"]).alias("s")).collect()]
    assert got == [1.0, pytest.approx(1 / 3), 0.0, 0.0]


def test_opener(spark):
    said = "The committee met in the large hall of the town yesterday evening"
    texts = [f"From: a@b.com\nPage 3 of 9\n12\n{said}. It then agreed on the plan for the coming year! And more.", "short", "", None, "word " * 100]
    got = [r.o for r in spark.createDataFrame([(t,) for t in texts], "t string").select(opener(F.col("t")).alias("o")).collect()]
    assert got[0] == f"{said}. It then agreed on the plan for the coming year."
    assert got[1:4] == ["short", "", None] and got[4].endswith("...") and len(got[4]) <= 203


def test_cycles(spark):
    square = [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (1, 4, 0.6)]
    shared = shared_folder(spark)
    tail = [tuple(round(x, 6) for x in r) for r in cycles.h1_persistence(edges(spark, square), shared).collect()]
    assert tail == [(0.4, 1.0, 0.6)]
    chord = [tuple(round(x, 6) for x in r) for r in cycles.h1_persistence(edges(spark, [*square, (1, 3, 0.5), (7, 8, 0.9)]), shared).collect()]
    assert chord == [(0.4, 0.5, 0.1)]
    assert cycles.h1_persistence(edges(spark, []), shared).count() == 0
    with pytest.raises(ValueError):
        cycles.h1_persistence(edges(spark, square), shared, max_edges=3)


def test_thresholds_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, j, round(rng.uniform(0.7, 1) if i // 6 == j // 6 else rng.uniform(0.1, 0.4), 4)) for i in range(18) for j in range(i + 1, 18) if rng.random() < 0.6]
    e, n = edges(spark, rows).repartition(3), 20
    grid = np.linspace(0.9, 0.2, 8)

    def labels(t):
        p = list(range(n))

        def root(x):
            while p[x] != x:
                x = p[x]
            return x

        for u, v, w in rows:
            if w >= t:
                p[max(root(u), root(v))] = min(root(u), root(v))
        return [root(i) for i in range(n)]

    got = {r["step"]: r["components"] for r in thresholds.components_by_step(e, grid.tolist(), n).collect()}
    assert got == {i: len(set(labels(t))) for i, t in enumerate(grid)}
    sil = {r["step"]: r["silhouette"] for r in thresholds.silhouette_by_step(e, grid.tolist(), shared_folder(spark)).collect()}
    for i, t in enumerate(grid):
        at = labels(t)
        a = [w for u, v, w in rows if at[u] == at[v]]
        b = [w for u, v, w in rows if at[u] != at[v]]
        assert sil[i] == (pytest.approx(np.mean(a) - np.mean(b)) if a and b else None)
    found = {r["method"]: r["threshold"] for r in thresholds.candidates(e, n, shared_folder(spark), n=10).collect()}
    assert set(found) == {"modularity", "persistence", "knee", "silhouette", "auto"}
    assert thresholds.candidates(edges(spark, []), 3, shared_folder(spark)).count() == 0


def test_eigenvector(spark):
    shared_folder(spark)
    rows = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0)]
    a = np.eye(4)
    for u, v, w in rows:
        a[u - 1, v - 1] = a[v - 1, u - 1] = w
    x = np.ones(4)
    for _ in range(30):
        x = a @ x / np.linalg.norm(a @ x)
    got = {r.node: r.score for r in centrality.eigenvector(edges(spark, rows)).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == pytest.approx(x.tolist())


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a <b>", None), (2, "c", 3)], "node long, name string, size int")
    for write, name in ((graph_files.write_graphml, "g.graphml"), (graph_files.write_gexf, "g.gexf")):
        write(nodes, edges(spark, [(1, 2, 0.5)]), str(tmp_path / name))
        doc = xml.dom.minidom.parse(str(tmp_path / name))
        assert len(doc.getElementsByTagName("node")) == 2 and len(doc.getElementsByTagName("edge")) == 1
    graph_files.write_edge_list(edges(spark, [(1, 2, 0.5)]), str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["1 2 0.5"]


def a_pdf() -> bytes:
    page = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj T* [(wor) -20 (ld)] TJ ET")
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << /Length " + str(len(page)).encode() + b" /Filter /FlateDecode >> stream\n" + page + b"\nendstream endobj\n"
        b"5 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R >> endobj\n6 0 obj << /Length 20 >> stream\nBT (second) Tj ET\nendstream endobj\n"
        b"7 0 obj << /Title (A title) /CreationDate (D:20200102030405Z) >> endobj\ntrailer << /Root 1 0 R /Info 7 0 R >>\n%%EOF"
    )


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(a_pdf())
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    got = {r.path.rsplit("/", 1)[1]: r for r in pdf.read_pdfs(spark, str(tmp_path)).collect()}
    assert (got["a.pdf"].pages, got["a.pdf"].text, got["a.pdf"].title) == (2, "Hello (you)\nworld\nsecond", "A title")
    assert got["b.pdf"].pages is None and got["b.pdf"].text is None and got["b.pdf"].info is None
    out = str(tmp_path / "out")
    assert pdf.extract_texts(spark, str(tmp_path), out, dry_run=True).count() == 2 and not store.exists(spark, out)
    pdf.extract_texts(spark, str(tmp_path), out)
    assert pdf.extract_texts(spark, str(tmp_path), out, dry_run=True).count() == 0 and spark.read.parquet(out).count() == 2


def test_store(spark, tmp_path):
    folder = str(tmp_path)
    aliases = spark.createDataFrame([("a", "manual"), ("b", "auto"), ("c", None)], "name string, method string")
    aliases.write.parquet(f"{folder}/aliases.parquet")
    spark.range(3).write.parquet(f"{folder}/other.parquet")
    assert {r.table_name: r.n for r in store.counts(spark, folder).collect()} == {"aliases": 3, "other": 3}
    features = {"names": {"aliases": F.col("method") == "manual", "missing": None}}
    assert store.reset(spark, folder, features, "names") == ["aliases"] and spark.read.parquet(f"{folder}/aliases.parquet").count() == 3
    store.reset(spark, folder, features, "names", dry_run=False)
    assert [r.name for r in spark.read.parquet(f"{folder}/aliases.parquet").collect()] == ["a"]
    assert store.drop(spark, folder, ["other", "nothing"], dry_run=False) == ["other"] and store.tables(spark, folder) == ["aliases"]
    at = f"{folder}/results"
    rows = spark.createDataFrame([(0.3, "a"), (0.5, "b")], "threshold double, x string")
    store.replace_partitions(rows, at, ["threshold"])
    store.replace_partitions(rows.where("threshold = 0.5").withColumn("x", F.lit("new")), at, ["threshold"])
    assert sorted((r.threshold, r.x) for r in spark.read.parquet(at).collect()) == [(0.3, "a"), (0.5, "new")]


def test_command_line(capsys):
    from quarrystone.__main__ import main

    main(["list"])
    assert "g6_similar_pairs" in capsys.readouterr().out.split()


def test_relations_of_all_line_items(spark):
    """Against a loop over the raw tables: each order joins its customer to the supplier of each of its line items, of any quantity."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    customer = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    kinds = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        if r.l_orderkey in customer:
            kind = "associate" if r.l_returnflag == "R" else "founder" if r.l_linestatus == "O" else "executive"
            kinds[customer[r.l_orderkey], 1_000_000_000 + r.l_suppkey].add((kind, r.l_quantity >= 50))
    found = registry.queries()["g25_entity_graph"](spark, sf).collect()
    assert {(r.u, r.v): (r.weight, r.types) for r in found} == {k: (len(s), ",".join(sorted({t for t, _ in s}))) for k, s in kinds.items()}


def test_corrections_by_brute_force(spark, tmp_path):
    """Misspelt words of any length against every dictionary word; the nearest within two edits, then the most frequent."""
    known = ["representation", "at", "house", "horse", "cat"]
    wrong = ["reprsentation", "reprezentaton", "hxrxe", "hous", "zq", "ax", "ct", "unrelatedness", "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(known if i else known + wrong), "en", "src0", 1) for i in range(5)] + [(5, "horse", "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").createOrReplaceTempView("documents")
    found = spark.sql(with_bases(Spark(), STATEMENTS["x27_spell_corrections"](Spark()))).collect()

    def following(row, x, b, i):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = following(row, x, b, i)
        return row[-1]

    freq = {w: 5 + (w == "horse") for w in known}
    wanted = {}
    for w in wrong:
        near = min((distance(w, k), -freq[k], k) for k in known)
        if near[0] <= 2:
            wanted[w] = near[2]
    assert {r.word: r.correction for r in found} == wanted and {"reprsentation", "reprezentaton", "hxrxe", "zq"} <= set(wanted)


@pytest.mark.parametrize("run", [lambda e, n: centrality.pagerank(e, rounds=n, tolerance=0.0), lambda e, n: centrality.eigenvector(e, rounds=n, tolerance=0.0), lambda e, n: centrality.label_propagation(e, rounds=n)])
def test_rounds_do_not_shuffle_the_edges(spark, run):
    rng = random.Random(8)
    e = edges(spark, [(i, j, rng.random()) for i in range(200) for j in range(i + 1, 200)]).checkpoint()

    def written(rounds):
        sc = spark.sparkContext._jsc.sc()
        total = []
        for _ in range(2):
            sc.listenerBus().waitUntilEmpty()
            total.append(sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size())))
            if len(total) == 1:
                run(e, rounds).collect()
        return total[1] - total[0]

    assert written(20) < 2 * written(5)
