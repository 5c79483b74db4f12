"""HTML extraction by a recurrent block labeller.

A page is its sequence of leaf blocks. Each block is two vectors, one of tag-path parts (tags and the known words of
their class, id and role; all unknown ones are one) and one of hashed words, with a few plain measures. A bidirectional LSTM in numpy reads the
whole sequence, so that every block is classified knowing all the others; blocks labelled as article are joined.

The labeller is trained here, on pages made by a grammar of common layouts whose labels are known: articles in various
containers, among navigation, headers, footers, sidebars, notices, adverts, forms and reader comments. It sees no row of
the corpus; one task trains it, in about a minute on one core, once a session and with the same result in every one, and its
arrays travel with the tasks that read pages.

Edge cases: null, empty and text-free pages have the text ''; unclosed and stray tags, see ``html_blocks``; a page of any
length is one sequence, none of its blocks is cut, and is read in time linear in its length; equal rows have equal texts;
an empty table gives an empty result; columns other than those named are passed through ``extract`` untouched, but for
ones named text or n_chars, which the result's replace.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import binary_array, pieces, small_batches, table
from quarrystone.llm.html_blocks import BLOCK_TAGS, Path, leaf_blocks
from quarrystone.llm.html_grammar import KNOWN, labelled_pages
from quarrystone.llm.words import U, Words

#: Places of a path's parts: one for all unknown names, one for all unknown tags, and one for each known one.
_PLACES = {x: i + 2 for i, x in enumerate([*sorted(BLOCK_TAGS), *("." + n for n in KNOWN)])}
PATH, WORDS, PLAIN, HIDDEN = len(_PLACES) + 2, 48, 6, 24
INPUT = PATH + WORDS + PLAIN
#: Probability from which a block is article. Text that is dropped is lost, so doubtful blocks stay: on held-out pages of the
#: grammar 99.5 % of blocks are right at 0.5 and at this figure, which keeps 99.7 % of article blocks instead of 99.5 %.
LEAST = 0.25


def _marks(path: Path) -> tuple[int, int]:
    """Places of the path's last element, and of all of them, as bits of a number; kept on the path, made from the outside in."""
    chain, at = [], path
    while at is not None and at.marks is None:
        chain.append(at)
        at = at.outer
    for at in reversed(chain):
        own = 0
        for x in (at.element[0], *("." + n for n in at.element[1:])):
            own |= 1 << _PLACES.get(x, 0 if x[0] == "." else 1)
        at.marks = (own, own | (at.outer.marks[1] if at.outer else 0))
    return path.marks


def _bits(numbers: list[int]) -> np.ndarray:
    size = -(-PATH // 8)
    held = np.frombuffer(b"".join(n.to_bytes(size, "little") for n in numbers), np.uint8).reshape(-1, size)
    return np.unpackbits(held, axis=1, count=PATH, bitorder="little").astype(np.float32)


def features(pages: list[list[tuple]]) -> np.ndarray:
    """One row a block, of all pages one after the other."""
    blocks = [b for page in pages for b in page]
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    near, all_ = [], []
    for path, _, _ in blocks:
        own, whole = _marks(path) if path else (0, 0)
        near.append(own | (path.outer.marks[0] if path and path.outer else 0))
        all_.append(whole)
    for low in range(0, len(blocks), 4096):
        high = low + 4096
        x[low:high, :PATH] = np.maximum(_bits(near[low:high]), np.float32(0.7) * _bits(all_[low:high]))
    w = Words(pa.array([b[1] for b in blocks], pa.large_string()), lower=True)
    row = w.row_of_words()
    counts = np.bincount(row * WORDS + (w.hashes() % U(WORDS)).astype(np.int64), minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = np.sqrt(counts / np.maximum(1, w.counts)[:, None])
    size = np.array([len(b[1]) for b in blocks], np.float32)
    n = np.array([len(p) for p in pages])
    nth = np.arange(len(blocks)) - np.repeat(np.cumsum(n) - n, n)
    x[:, -6] = np.log1p(size) / 6
    x[:, -5] = [b[2] for b in blocks]
    x[:, -4] = [b[1][-1] in ".!?…\"”»:" for b in blocks]
    x[:, -3] = np.minimum(1, w.counts / 40)
    x[:, -2] = nth / np.maximum(1, np.repeat(n, n))
    x[:, -1] = 1
    return x


def _padded(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, inputs) and which cells are blocks."""
    mask = np.arange(n.max())[:, None] < n[None]
    out = np.zeros((*mask.shape, x.shape[1]), np.float32)
    out.transpose(1, 0, 2)[mask.T] = x
    return out, mask


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _direction(p: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction; padding leaves the state as it is."""
    steps, pages, _ = x.shape
    z = x.reshape(-1, x.shape[2]) @ p[d + "x"] + p[d + "b"]
    z = z.reshape(steps, pages, -1)
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = z[t] + h @ p[d + "h"]
        gates, new = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        live = mask[t][:, None]
        c2 = np.where(live, f * c + i * new, c)
        h2 = np.where(live, o * np.tanh(c2), h)
        if keep is not None:
            keep.append((t, h, c, c2, i, f, o, new, live))
        h, c = h2, c2
        out[t] = h
    return out


def scores(p: dict, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability of each block being article, pages in batches of like length."""
    out = np.zeros(len(x), np.float32)
    at = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and high - low < 512 and (high + 1 - low) * n[order[high]] <= 16_384:
            high += 1
        pick = order[low:high]
        m = n[pick]
        spots = np.arange(int(m.sum())) + np.repeat(at[pick] - (np.cumsum(m) - m), m)
        cells, mask = _padded(x[spots], m)
        both = np.concatenate([_direction(p, "f", cells, mask), _direction(p, "r", cells, mask)], axis=2)
        z = both @ p["o"] + p["ob"]
        out[spots] = _sigmoid(z[:, :, 0]).T[mask.T]
        low = high
    return out


def _back(p: dict, g: dict, d: str, x: np.ndarray, kept: list, dh_out: np.ndarray) -> None:
    dh = np.zeros_like(kept[0][1])
    dc = np.zeros_like(dh)
    for t, h, c, c2, i, f, o, new, live in reversed(kept):
        dh = dh + dh_out[t]
        th = np.tanh(c2)
        dc2 = np.where(live, dh * o * (1 - th * th), 0) + dc
        do = np.where(live, dh * th, 0)
        dcl = np.where(live, dc2, 0)
        dz = np.concatenate([dcl * new * i * (1 - i), dcl * c * f * (1 - f), do * o * (1 - o), dcl * i * (1 - new * new)], axis=1)
        g[d + "x"] += x[t].T @ dz
        g[d + "h"] += h.T @ dz
        g[d + "b"] += dz.sum(axis=0)
        dh = dz @ p[d + "h"].T + np.where(live, 0, dh)
        dc = np.where(live, dc2 * f, dc2)


def train(pages: list[tuple[list[tuple], list[bool]]], epochs: int = 10, batch: int = 48, seed: int = 4) -> dict:
    """The labeller's arrays, from (blocks, labels) of pages, by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {"o": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "ob": np.zeros(1)}
    for d in "fr":
        p |= {d + "x": rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)), d + "h": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), d + "b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    pages = [x for x in pages if x[0]]
    x = features([blocks for blocks, _ in pages])
    n = np.array([len(b) for b, _ in pages])
    at = np.cumsum(n) - n
    y = np.concatenate([np.array(labels, np.float32) for _, labels in pages])
    step, total = 0, epochs * -(-len(pages) // batch)
    for _ in range(epochs):
        order = np.argsort(n + rng.uniform(0, 6, len(n)))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for k in rng.permutation(len(groups)):
            pick, step = groups[k], step + 1
            spots = np.concatenate([np.arange(at[i], at[i] + n[i]) for i in pick])
            cells, mask = _padded(x[spots], n[pick])
            want = np.zeros(mask.shape, np.float32)
            want.T[mask.T] = y[spots]
            kept: dict[str, list] = {"f": [], "r": []}
            both = np.concatenate([_direction(p, d, cells, mask, kept[d]) for d in "fr"], axis=2)
            prob = _sigmoid((both @ p["o"] + p["ob"])[:, :, 0])
            dz = np.where(mask, prob - want, 0)[:, :, None] / mask.sum()
            g = {key: np.zeros_like(a) for key, a in p.items()}
            g["o"], g["ob"] = np.einsum("tbh,tbo->ho", both, dz), dz.sum(axis=(0, 1))
            dh = dz @ p["o"].T
            _back(p, g, "f", cells, kept["f"], dh[:, :, :HIDDEN])
            _back(p, g, "r", cells, kept["r"], dh[:, :, HIDDEN:])
            norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
            rate = 0.01 * min(1.0, 2 * (1 - step / (total + 1))) * min(1.0, 1 / (norm + 1e-9))
            for key in p:
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                v[key] = 0.995 * v[key] + 0.005 * g[key] ** 2
                p[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return p


PAGES = 5000
_model: dict | None = None


def model() -> dict:
    global _model
    if _model is None:
        _model = train(labelled_pages(PAGES))
    return _model


def trained(spark: SparkSession) -> dict:
    """The labeller, trained by one task and kept for the session."""
    global _model
    if _model is None:

        def run(batches):
            for _ in batches:
                held = io.BytesIO()
                np.savez(held, **model())
                yield pa.RecordBatch.from_arrays([binary_array([held.getvalue()])], names=["arrays"])

        found = spark.range(1, numPartitions=1).mapInArrow(run, "arrays binary").first()["arrays"]
        with np.load(io.BytesIO(found)) as held:
            _model = {k: held[k] for k in held.files}
    return _model


def main_texts(htmls: list[str | None], p: dict) -> list[str]:
    pages = [leaf_blocks(h) for h in htmls]
    n = np.array([len(b) for b in pages], np.int64)
    good = scores(p, features(pages), n) >= LEAST
    cut = np.cumsum(n)
    return ["\n\n".join(b[1] for b, g in zip(page, good[end - len(page) : end]) if g) for page, end in zip(pages, cut.tolist())]


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, p: dict | None = None) -> DataFrame:
    """The ``keep`` columns (all but ``html`` if None) with text and n_chars."""
    keep = [c for c in (pages.columns if keep is None else keep) if c != html and c.lower() not in ("text", "n_chars")]
    small_batches(pages.sparkSession)
    held = p or trained(pages.sparkSession)
    body = "html"
    while body.lower() in {c.lower() for c in keep}:
        body = "_" + body
    rows = pages.select(*keep, F.col(html).alias(body))
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    n_keep = len(keep)

    def run(batches):
        for batch in pieces(batches, body):
            texts = main_texts(batch.column(n_keep).to_pylist(), held)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(texts, pa.string()), sizes], names=schema.names)

    return rows.mapInArrow(run, schema)


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
