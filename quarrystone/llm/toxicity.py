"""Toxicity by a linear classifier, regularised with counterfactuals, trained in numpy.

Features are hashed: each word of the lower-cased text, its beginnings of 4, 6 and 8 bytes and its last 5, so that
languages which build words out of others are covered; a feature counts 1 + log2 of its occurrences, 3 at most. Of 2^20
places those ``KEPT`` stay whose presence tells most of the classes (chi-squared). The loss is logistic, each class weighing
what it does among all labelled rows, with an L1 and an L2 term and the counterfactual penalty: in each labelled passage that
names a group the names are swapped for others of their kind, or for a neutral word, and the squares of the changes that this
makes to the score are penalised. A group's name can then not carry what stands near it in the labelled rows, and
passages that merely mention a group keep low scores. The fit is accelerated proximal gradient descent (monotone restarts).

Training reads labels of rows whose crc32(id) mod 4 is not 2: at most ``PER_CLASS`` documents of each label, chosen by a hash of
the id, and of each at most ``PASSAGE`` characters, from anywhere in it. Scores read the whole text and nothing else.

Edge cases: null text is empty text, whose score is that of a text without features; long texts are read in runs of a
megabyte, cut between words (a word beyond that is cut where the run ends); a null id counts as the id '' for the
split and has no label; of repeated labels the largest holds, of repeated ids the least passage is learnt from; labels but 0
and 1 are ignored; equal texts have equal scores. Without labels of both kinds every score is the share of toxic labels, 0
without labels. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, small_batches, table, worker_own

PLACES, KEPT, BEGINNINGS, ENDING = 20, 8192, (4, 6, 8), 5
PER_CLASS, PASSAGE, SWAPS, STEPS, SEED = 3000, 8192, 2, 300, 11
L1, L2, COUNTERFACTUAL, THRESHOLD = 1e-4, 1e-4, 1.0, 0.3
RUN = 1 << 20

#: Names of groups by kind, with the neutral words that may stand in their place. A parameter: any kinds and words will do.
IDENTITIES = {
    "belief": ("christian muslim jewish hindu buddhist catholic protestant sikh atheist mormon", "local"),
    "believers": ("christians muslims jews hindus buddhists catholics protestants sikhs atheists mormons", "people"),
    "origin": ("african american arab asian chinese european french german indian irish italian japanese korean mexican polish russian spanish turkish", "local"),
    "peoples": ("africans americans arabs asians europeans germans indians italians mexicans russians turks", "people"),
    "colour": ("black white brown latino latina hispanic", "young"),
    "orientation": ("gay lesbian straight bisexual homosexual heterosexual queer trans transgender", "young"),
    "sex": ("woman man girl boy lady gentleman", "person"),
    "sexes": ("women men girls boys ladies gentlemen", "people"),
    "state": ("disabled deaf blind autistic elderly old", "young"),
    "glaube": ("christen muslime juden hindus buddhisten katholiken protestanten atheisten", "leute"),
    "croyants": ("chrétiens musulmans juifs hindous bouddhistes catholiques protestants athées", "gens"),
    "creyentes": ("cristianos musulmanes judíos hindúes budistas católicos protestantes ateos", "personas"),
}


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, RUN + 4096)
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all features of lower-cased text: where in the bytes a word begins, and the hash's place."""
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    low, high = edge[::2], edge[1::2]
    up, down = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    size = high - low
    spans = [(low, low, high)]
    spans += [(low[size > n], low[size > n], low[size > n] + n) for n in BEGINNINGS]
    spans.append((low[size > ENDING], high[size > ENDING] - ENDING, high[size > ENDING]))
    places, hashes = [], []
    for kind, (at, a, b) in enumerate(spans):
        h = (prefix[b] - prefix[a]) * down[a] + np.uint64(kind)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        places.append(at), hashes.append((h >> np.uint64(64 - PLACES)).astype(np.int32))
    return np.concatenate(places), np.concatenate(hashes)


def _runs(data: np.ndarray, at: np.ndarray):
    """Runs of whole texts of a megabyte in all, or parts of a longer one: (first byte, last byte)."""
    low = 0
    while low < len(data):
        high = int(at[np.searchsorted(at, low + RUN, "right") - 1])
        if high <= low:
            high = low + RUN
            gap = np.flatnonzero(~_WORD[data[low:high]])
            high = low + int(gap[-1]) + 1 if len(gap) else high
        yield low, min(high, len(data))
        low = high


def text_features(texts: pa.Array, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a batch of texts, ordered; of the hashes with a number in ``known`` that number, or all."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    # a space after each text, so that words end with it
    low = pc.binary_join_element_wise(low, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    at = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    data = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    rows, found, width = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1 << PLACES
    for a, b in _runs(data, at):
        places, hashes = features(data[a:b])
        numbers = hashes if known is None else known[hashes]
        if known is not None:
            places, numbers = places[numbers >= 0], numbers[numbers >= 0]
        rows.append(np.searchsorted(at, places + a, "right") - 1), found.append(numbers.astype(np.int64))
    key, times = np.unique(np.concatenate(rows) * width + np.concatenate(found), return_counts=True)
    return key // width, key % width, np.minimum(1 + np.log2(times), 3)


def training_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, per_class: int, passage: int) -> tuple[list[tuple[int, str]], list[int]]:
    """At most ``per_class`` (label, passage) of each label, and how many labelled ids there are of each."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.xxhash64(F.lit(SEED), F.col("id"))
    some = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(draw, "id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    begin = F.pmod(F.xxhash64(F.col(id), F.lit(SEED)), F.greatest(F.lit(1), F.length(text) - passage)).cast("int") + 1
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).substr(begin, F.lit(passage)).alias("passage"))
    rows = texts.join(F.broadcast(some), "id").groupBy("id", "label").agg(F.min("passage").alias("passage")).select("label", "passage")
    return sorted((r["label"], r["passage"]) for r in rows.collect()), [total.get(0, 0), total.get(1, 0)]


def swapped(text: str, identities: dict, rng: random.Random) -> str | None:
    """``text`` with every group's name swapped for another of its kind or for the neutral word; None if it has none."""
    others = {w: (*terms.split(), neutral) for terms, neutral in identities.values() for w in terms.split()}
    pattern = worker_pattern(tuple(others))
    if not pattern.search(text):
        return None
    return pattern.sub(lambda m: rng.choice([o for o in others[m[0].lower()] if o != m[0].lower()]), text)


_patterns: dict[tuple, re.Pattern] = {}


def worker_pattern(words: tuple[str, ...]) -> re.Pattern:
    if words not in _patterns:
        _patterns[words] = re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)
    return _patterns[words]


class Rows:
    """Sparse rows of features, for products with vectors."""

    def __init__(self, texts: list[str], known: np.ndarray | None, width: int):
        self.n, self.width = len(texts), width
        parts = []
        for low in range(0, len(texts), 256):
            r, f, v = text_features(pa.array(texts[low : low + 256], pa.large_string()), known)
            parts.append((r + low, f.astype(np.int32), v.astype(np.float32)))
        self.row, self.at, self.value = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * g[self.row], self.width)


def _select(texts: list[str], y: np.ndarray, kept: int) -> np.ndarray:
    """The places of the ``kept`` features whose presence tells most of the classes; at least two texts have each."""
    seen = np.zeros((2, 1 << PLACES))
    for low in range(0, len(texts), 256):
        r, f, _ = text_features(pa.array(texts[low : low + 256], pa.large_string()), None)
        for c in (0, 1):
            seen[c] += np.bincount(f[y[low + r] == c], minlength=1 << PLACES)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    a, b = seen[1], seen[0]
    c, d = n[1] - a, n[0] - b
    chi = (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d), 1)
    chi[a + b < 2] = 0
    best = np.argsort(-chi, kind="stable")[:kept]
    return np.sort(best[chi[best] > 0])


def train(
    sample: list[tuple[int, str]], totals: list[int], counterfactual: float = COUNTERFACTUAL, identities: dict = IDENTITIES, kept: int = KEPT, steps: int = STEPS
) -> dict:
    """The classifier: ``places`` of its features among the hashes, their ``weights`` and the ``bias``."""
    share = totals[1] / sum(totals) if sum(totals) else 0.0
    texts, y = [t for _, t in sample], np.array([c for c, _ in sample], np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return {"places": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 0.0, "constant": share}
    places = _select(texts, y, kept)
    known = np.full(1 << PLACES, -1, np.int32)
    known[places] = np.arange(len(places))
    x = Rows(texts, known, len(places))
    rng = random.Random(SEED)
    pairs = [(t, s) for t in texts for _ in range(SWAPS) if (s := swapped(t, identities, rng)) is not None] if counterfactual else []
    one, other = (Rows([p[i] for p in pairs], known, len(places)) for i in (0, 1))
    weight = np.array([totals[c] / max(1, (y == c).sum()) for c in (0, 1)])[y]
    weight = weight / weight.sum()
    changes = counterfactual / max(1, len(pairs))

    def curved(w: np.ndarray) -> np.ndarray:
        """The penalties' part of the gradient."""
        gap = (one.times(w) - other.times(w)) * changes if pairs else None
        return L2 * w + (one.back(gap) - other.back(gap) if pairs else 0)

    w = rng_vector = np.random.default_rng(SEED).normal(size=len(places))
    top = 1.0
    for _ in range(12):  # how steep the smooth part can be, by the power method
        w = rng_vector / max(np.linalg.norm(rng_vector), 1e-300)
        rng_vector = x.back(x.times(w) * weight) / 4 + curved(w)
        top = np.linalg.norm(rng_vector)
    step = 1 / (1.3 * top + 0.25)
    w, b, t = np.zeros(len(places)), float(np.log(share / (1 - share))), 1.0
    v, c, before = w, b, np.inf
    for _ in range(steps):
        z = x.times(v) + c
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = weight * (p - y)
        new = v - step * (x.back(g) + curved(v))
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        bias = c - step * g.sum()
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() + L1 * np.abs(v).sum() + L2 / 2 * (v * v).sum())
        t = 1.0 if loss > before else t
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / after * (new - w), bias + (t - 1) / after * (bias - b)
        w, b, t, before = new, bias, after, loss
    held = w != 0
    return {"places": places[held], "weights": w[held], "bias": b, "constant": None}


def _table_of(model: dict) -> np.ndarray:
    known = np.full(1 << PLACES, -1, np.int32)
    known[model["places"]] = np.arange(len(model["places"]))
    return known


def scores(model: dict, texts: pa.Array) -> np.ndarray:
    if model["constant"] is not None:
        return np.full(len(texts), model["constant"])
    known = worker_own(("toxicity", model["weights"].tobytes(), model["places"].tobytes()), lambda: _table_of(model))
    row, at, value = text_features(texts, known)
    z = np.bincount(row, value * model["weights"][at], len(texts)) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: dict, text: str = "text", to: str = "_toxicity") -> DataFrame:
    """``docs`` (all columns) with the score ``to`` of their whole texts; a column that has this name already is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(to)
    columns, where = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(model, batch.column(where)))], names=[*columns, to])

    return docs.mapInArrow(run, docs.withColumn(to, F.lit(None).cast("double")).schema)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, passage: int = PASSAGE) -> dict:
    return train(*training_sample(docs, labels, id, text, label, per_class, passage))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("_toxicity") >= THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), predicted.alias("predicted"))
