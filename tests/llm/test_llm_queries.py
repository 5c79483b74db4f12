"""Every query of the subpackage over the smallest tables: those with SQL agree with it, the pipeline with its stages' rules."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from quarrystone.llm import registry
from quarrystone.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees(spark, checker, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = checker.sql(registry.ORACLE_SQL[name])
    cols = sorted(found.columns)
    assert cols == sorted(wanted.columns)
    at = [list(wanted.columns).index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=repr)


def _ids(checker, vocabulary, end):
    from public_tokenizers import path

    held = Tokenizer.from_file(str(path(vocabulary)))
    rows = checker.sql("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()
    return {i: [*held.encode(text, add_special_tokens=False).ids, end] for i, text in rows}


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query(spark, checker):
    want, before = {}, 0
    for i, ids in _ids(checker, "byte_bpe_50k.json", 0).items():
        want[i] = (before, len(ids), _crc(ids))
        before += len(ids)
    found = registry.QUERIES["op7_token_files"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want and len(found) == len(want)


def test_packing_query(spark, checker):
    ids = _ids(checker, "word_bpe_49k.json", 1)
    pieces, full = defaultdict(list), defaultdict(list)
    for r in registry.QUERIES["op4_pack_sequences"](spark, SF).collect():
        assert r.ids_crc32 == _crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        full[r.sequence_id].append((r.offset, r.length))
    for places, whole in [(p, len(ids[i])) for i, p in pieces.items()] + [(p, None) for p in full.values()]:
        places.sort()
        ends = [a + n for a, n in places]
        assert [a for a, _ in places] == [0, *ends[:-1]] and (ends[-1] == whole if whole else ends[-1] <= 2048)
    assert pieces.keys() == ids.keys()


def test_neighbours_query(spark, checker):
    rows = checker.sql("select * from embeddings").fetchall()
    names = checker.sql("select * from embeddings limit 0").columns
    at, vec = names.index("vec_id"), next(i for i, v in enumerate(rows[0]) if isinstance(v, (list, tuple)))
    x = {r[at]: np.array(r[vec], float) for r in rows if r[vec] is not None}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    hits = total = 0
    found = defaultdict(dict)
    for r in registry.QUERIES["op6_nearest_neighbours"](spark, SF).collect():
        q, v = x[r.query_id], x[r.vec_id]
        assert r.score == pytest.approx(q @ v / np.linalg.norm(q) / np.linalg.norm(v), abs=1e-12)
        found[r.query_id][r["rank"]] = r.vec_id
    for q in (i for i in x if i % 50 == 0):
        best = sorted((-(x[q] @ v) / np.linalg.norm(x[q]) / np.linalg.norm(v), i) for i, v in x.items() if i != q)[:5]
        assert sorted(found[q]) == list(range(1, len(best) + 1))
        hits, total = hits + len({i for _, i in best} & set(found[q].values())), total + len(best)
    assert hits >= 0.9 * total


def test_language_query(spark, checker):
    lang = dict(checker.sql("select doc_id, lang from documents").fetchall())
    found = registry.QUERIES["op10_language_id"](spark, SF).collect()
    assert {r.doc_id for r in found} == lang.keys() and len(found) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    told = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out and lang[r.doc_id] is not None]
    assert sum(told) >= 0.9 * len(told)


def test_pages_query(spark, checker):
    found = registry.QUERIES["op1_html_text"](spark, SF).collect()
    assert Counter(r.page_id for r in found) == Counter(r[0] for r in checker.sql("select page_id from pages").fetchall())
    assert all(r.n_chars == len(r.text) and "<" not in r.text[:1] and r.text == r.text.strip() for r in found)


def test_pipeline_run(spark, checker):
    import corpus_pipeline

    texts = dict(checker.sql("select doc_id, text from documents").fetchall())
    stages, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        stages[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert stages["language ID"] == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    normal = lambda t: "".join(c for c in t if c not in " \t\n\v\f\r")
    assert len({normal(texts[i]) for i in stages["exact dedup"]}) == len(stages["exact dedup"]) == len({normal(texts[i]) for i in stages["language ID"]})
    sets = {}
    for i in stages["exact dedup"]:
        w = "".join(c.lower() if c.isascii() else c for c in texts[i]).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    near = {i: i for i in sets}

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                near[max(root(a), root(b))] = min(root(a), root(b))
    assert stages["n-gram Jaccard join"] == {root(i) for i in sets}
    assert stages["mixing sources"] <= stages["n-gram Jaccard join"]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == stages["mixing sources"]
    filled = defaultdict(int)
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_whitening_query(spark, checker):
    x = np.array([r[0] for r in checker.sql("select embedding from embeddings order by vec_id").fetchall()], float)
    ids = [r[0] for r in checker.sql("select vec_id from embeddings order by vec_id").fetchall()]
    x = np.floor(1024 * x).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, w = np.linalg.eigh(y.T @ y / n)
    white = y @ w[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    place = {i: k for k, i in enumerate(ids)}
    found = registry.QUERIES["op11_embedding_whitening"](spark, SF).collect()
    got = np.zeros((n, 8))
    for r in found:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[place[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[::-1][r.component - 1] / e.sum(), rel=1e-9)
    assert len(found) == 8 * n and np.allclose(got * np.sign((got * white).sum(axis=0)), white, atol=1e-7)


def test_toxicity_query(spark, checker):
    toxic = dict(checker.sql("select doc_id, toxic from labels").fetchall())
    found = registry.QUERIES["op13_toxicity"](spark, SF).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in checker.sql("select doc_id from documents").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    told = [r.predicted == toxic[r.doc_id] for r in found if r.doc_id in toxic]
    assert sum(told) >= 0.95 * len(told)
