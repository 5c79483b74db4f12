"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded; filters of widths 2, 3 and 4 slide over windows of 128 bytes; each filter's largest activation over
the window goes through a ReLU into a softmax. A text's prediction is the mean of its windows' probabilities, weighted by
their bytes, so every byte of every text counts. For application the convolutions are tabulated: over pairs of bytes a
filter's response is a sum of one or two table rows, so a batch of windows is gathers, additions and one maximum.

Training reads only ``text`` and non-null ``lang`` of rows whose crc32(id) mod 5 is not 0, from a sample bounded by
``per_lang`` rows a language (chosen by a hash of the id) and 2,048 characters a row, of every language there is; prediction
reads only the text.

Edge cases: null text, empty text and text without a letter are ``und`` with score 0; a null id counts as the id '' for
the split; a long text is a long row of windows; equal rows have equal results; ties go to the language first in order;
if there is nothing to learn from, every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, small_batches, stored, table, worker_own

LENGTH, WIDTHS, FILTERS, DIM = 128, (2, 3, 4), 16, 8
PER_LANG, STEPS, BATCH, SEED = 400, 260, 96, 7
#: Languages up to which their counts are broadcast; more of them meet the rows by shuffle.
BROADCAST = 1 << 18
UNDETERMINED = "und"


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, id: str, text: str, lang: str, per_lang: int) -> list[tuple[str, str]]:
    """At most ``per_lang`` (lang, passage) a language; the passage starts anywhere in the text."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(F.col(id)))
    counts = stored(rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("of")), "language-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(id)), F.lit(1 << 30))
    rate = F.lit(1.5 * per_lang * (1 << 30)) / F.col("of")
    begin = F.pmod(F.xxhash64(F.col(id), F.lit(SEED)), F.greatest(F.lit(1), F.length(text) - 2048)).cast("int") + 1
    some = rows.select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text"), begin.alias("begin"))
    some = some.join(counts, "lang").where(F.col("draw") <= rate).select("lang", "draw", F.col("text").substr(F.col("begin"), F.lit(2048)).alias("passage"))
    order = Window.partitionBy("lang").orderBy("draw", "passage")
    some = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang)
    return sorted((r["lang"], r["passage"]) for r in some.select("lang", "passage").collect())


def _windows(sample: list[tuple[str, str]], langs: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: whole ones, and as many cut short, since short texts come padded with zeros."""
    xs, ys = [], []
    for lang, passage in sample:
        held = np.frombuffer(passage.encode(), np.uint8)
        for short in (False, True, True):
            size = int(rng.integers(8, LENGTH)) if short else LENGTH
            low = int(rng.integers(0, max(1, len(held) - size)))
            x = np.zeros(LENGTH + max(WIDTHS) - 1, np.uint8)
            part = held[low : low + size]
            x[: len(part)] = part
            xs.append(x), ys.append(langs.index(lang))
    return np.array(xs), np.array(ys)


def train(sample: list[tuple[str, str]], steps: int = STEPS, seed: int = SEED) -> dict | None:
    """The network's arrays, by Adam on cross-entropy."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = _windows(sample, langs, rng)
    share = np.bincount(ys, minlength=len(langs)) / len(ys)
    p = {"embed": rng.normal(0, 0.5, (256, DIM)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "bias": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(xs), BATCH)
        x, y = xs[pick], ys[pick]
        e = p["embed"][x]
        pooled, arg = [], []
        for w in WIDTHS:
            seen = np.concatenate([e[:, j : j + LENGTH] for j in range(w)], axis=2)
            act = seen @ p[f"w{w}"] + p[f"b{w}"]
            arg.append(act.argmax(axis=1))
            pooled.append(np.take_along_axis(act, arg[-1][:, None], axis=1)[:, 0])
        hidden = np.concatenate(pooled, axis=1)
        relu = np.maximum(hidden, 0)
        logits = relu @ p["out"] + p["bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        d = prob.copy()
        d[np.arange(BATCH), y] -= 1
        d *= (1 / (len(langs) * share[y]))[:, None] / BATCH
        g = {"out": relu.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        dh = (d @ p["out"].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            dw = dh[:, i * FILTERS : (i + 1) * FILTERS]
            places = arg[i][:, :, None] + np.arange(w)  # batch, filter, width
            held = x[np.arange(BATCH)[:, None, None], places]
            seen = p["embed"][held].reshape(BATCH, FILTERS, w * DIM)
            g[f"w{w}"] = np.einsum("bfk,bf->kf", seen, dw)
            g[f"b{w}"] = dw.sum(axis=0)
            back = (dw[:, :, None] * p[f"w{w}"].T[None]).reshape(-1, DIM)
            np.add.at(g["embed"], held.reshape(-1), back)
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p | {"langs": langs}


class Network:
    """The network tabulated for application; see the module's text."""

    def __init__(self, p: dict):
        self.langs, self.out, self.bias = p["langs"], p["out"], p["bias"]
        e = p["embed"]

        def table_of(w: int, j: int) -> np.ndarray:
            return e @ p[f"w{w}"][j * DIM : (j + 1) * DIM]

        def pairs(w: int, j: int) -> np.ndarray:
            return (table_of(w, j)[:, None] + table_of(w, j + 1)[None]).reshape(65536, FILTERS)

        self.first = np.ascontiguousarray(np.concatenate([pairs(w, 0) + p[f"b{w}"] for w in WIDTHS], axis=1))
        self.third, self.last = table_of(3, 2), pairs(4, 2)

    def windows(self, flat: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n windows; ``flat`` holds their bytes end to end, and three more."""
        out = np.empty((n, len(self.langs)), np.float32)
        pair = flat[:-1].astype(np.uint16) << 8 | flat[1:]
        for low in range(0, n, 128):
            high = min(n, low + 128)
            a, b = low * LENGTH, high * LENGTH
            act = self.first[pair[a:b]]
            act[:, FILTERS : 2 * FILTERS] += self.third[flat[a + 2 : b + 2]]
            act[:, 2 * FILTERS :] += self.last[pair[a + 2 : b + 2]]
            pooled = np.maximum(act.reshape(high - low, LENGTH, -1).max(axis=1), 0)
            logits = pooled @ self.out + self.bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[low:high] = prob / prob.sum(axis=1, keepdims=True)
        return out

    def texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of texts given as bytes and CSR offsets."""
        size = np.diff(at)
        count = np.maximum(1, -(-(size + max(WIDTHS) - 1) // LENGTH))
        first = np.cumsum(count) - count
        total = int(count.sum())
        flat = np.zeros(total * LENGTH + 3, np.uint8)
        flat[np.arange(len(data)) + np.repeat(first * LENGTH - at[:-1], size)] = data
        nth = np.arange(total) - np.repeat(first, count)
        weight = np.clip(np.repeat(size, count) - nth * LENGTH, 0, LENGTH).astype(np.float64)
        prob = self.windows(flat, total) * weight[:, None]
        return np.add.reduceat(prob, first, axis=0) / np.maximum(size, 1)[:, None]


def _unused(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def identify(docs: DataFrame, model: dict | None, id: str = "doc_id", text: str = "text", lang: str = "_lang", score: str = "_score") -> DataFrame:
    """``docs`` (all columns) with ``lang`` and ``score``; columns that have these names already are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(lang, score)
    columns = docs.columns
    named = docs.withColumns({lang: F.lit(None).cast("string"), score: F.lit(None).cast("double")})
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    where, n_columns = columns.index(text), len(columns)

    def run(batches):
        network = None
        if model is not None:
            network = worker_own(("network", model["out"].tobytes()), lambda: Network(model))
        for batch in pieces(batches, text):
            n = batch.num_rows
            known = batch.column(n_columns).to_numpy(zero_copy_only=False).astype(bool)
            langs, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
            rows = np.flatnonzero(known)
            if network is not None and len(rows):
                held = batch.column(where).take(pa.array(rows)).cast(pa.large_string())
                at = np.frombuffer(held.buffers()[1], np.int64, len(rows) + 1, held.offset * 8)
                data = np.frombuffer(held.buffers()[2], np.uint8)[at[0] : at[-1]]
                prob = network.texts(data, at - at[0])
                best = prob.argmax(axis=1)
                langs[rows] = np.array(network.langs, object)[best]
                scores[rows] = np.clip(prob[np.arange(len(rows)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], pa.array(langs, pa.string()), pa.array(scores)], names=[*columns, lang, score])

    return docs.withColumn(_unused(columns, "_lettered"), lettered).mapInArrow(run, named.schema)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> dict | None:
    return train(training_sample(docs, id, text, lang, per_lang))


def keep_identified(docs: DataFrame, model: dict | None, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns of any name, whose language the network can tell: a letter at least, and a score of
    ``least`` or more. Null text, empty text and texts without a letter go; without a model all go; rows may repeat."""
    lang, score = _unused(docs.columns, "_lang"), _unused(docs.columns, "_score")
    found = identify(docs, model, text=text, lang=lang, score=score)
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(docs.columns)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
