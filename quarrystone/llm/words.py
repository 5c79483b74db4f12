"""Vectorised word kernel: words, hashes and word windows of a batch of texts, without a Python loop over words.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Null texts count as empty. Hashes are 64 bits: a polynomial
over uint64 with odd base (invertible modulo 2**64, so any run's hash is a difference of prefix sums), then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the worker, rebuilt when a longer run comes."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, _inverse(base), U)
        up[0] = down[0] = 1
        got = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 20:
            _powers[int(base)] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """The words of an Arrow string array: ``starts``/``ends`` are byte places in ``data``, ``off`` the words' CSR by row."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        held = texts.buffers()[2]
        raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        self.data = raw[at[0] : at[-1]]
        self.at = at - at[0]
        if lower:
            self.data = _LOWER[self.data]
        size = len(self.data)
        solid = ~_IS_SPACE[self.data]
        edge = np.zeros(size + 1, bool)
        edge[self.at] = True
        before = np.empty(size, bool)
        if size:
            before[0] = False
            before[1:] = solid[:-1]
        before &= ~edge[:-1]
        self.starts = np.flatnonzero(solid & ~before)
        after = np.empty(size, bool)
        if size:
            after[-1] = False
            after[:-1] = solid[1:]
        after &= ~edge[1:]
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.off = np.searchsorted(self.starts, self.at)
        self.rows = n

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Of each word, or of the given byte spans."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        up, down = powers(_BASE, len(self.data) + 1)
        sums = prefix((self.data.astype(U) + U(1)) * up[: len(self.data)])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h ^ ((ends - starts).astype(U) * U(0xA0761D6478BD642F)))

    def run_hashes(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 of ``h`` have none. Runs may cross rows: see ``inside``."""
        m = max(0, len(h) - k + 1)
        up, down = powers(_WORD_BASE, len(h) + 1)
        sums = prefix(h * up[: len(h)])
        return mix((sums[k : k + m] - sums[:m]) * down[:m] + U(k))

    def row_hashes(self, h: np.ndarray) -> np.ndarray:
        """128-bit hash (two columns) of each row's whole word sequence."""
        out = np.empty((self.rows, 2), U)
        for j, base in enumerate((_WORD_BASE, _BASE)):
            up, down = powers(base, len(h) + 1)
            sums = prefix(h * up[: len(h)])
            out[:, j] = mix((sums[self.off[1:]] - sums[self.off[:-1]]) * down[self.off[:-1]] + self.counts.astype(U))
        return out

    def inside(self, k: int) -> np.ndarray:
        """Which of the runs of k words lie in one row."""
        m = max(0, len(self) - k + 1)
        step = np.zeros(len(self) + 1, np.int32)
        np.add.at(step, np.maximum(self.off[:-1], self.off[1:] - k + 1), 1)
        np.add.at(step, self.off[1:], -1)
        return np.cumsum(step[:m]) == 0

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each row joined by one space: bytes and CSR offsets by row."""
        size = len(self.data)
        out = self.data.copy()
        s, e = self.starts[keep], self.ends[keep]
        rows = self.row_of_words()[keep]
        lead = np.empty(len(s), bool)
        if len(s):
            lead[0] = False
            lead[1:] = rows[1:] == rows[:-1]
        out[s[lead] - 1] = 0x20
        step = np.zeros(size + 1, np.int8)
        step[s - lead] += 1
        np.subtract.at(step, e, 1)
        mask = np.cumsum(step[:size], dtype=np.int8) > 0
        sums = np.zeros(size + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return out[mask], sums[self.at]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of k words of each row, sorted within the row; a row of fewer words has its whole
    sequence as one, a row without words none. Returns hashes and CSR offsets."""
    h = words.hashes()
    counts = words.counts
    runs, ok = words.run_hashes(h, k), words.inside(k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = words.row_hashes(h)[short, 0]
    rows = words.row_of_words()
    rows = np.concatenate([rows[: len(runs)][ok], short])
    hashes = np.concatenate([runs[ok], whole])
    if len(short):
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    cut = np.searchsorted(rows, np.arange(words.rows + 1))
    hashes = hashes.copy()
    for i in range(words.rows):
        hashes[cut[i] : cut[i + 1]].sort()
    first = np.ones(len(hashes), bool)
    if len(hashes):
        first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    rows, hashes = rows[first], hashes[first]
    return hashes, np.searchsorted(rows, np.arange(words.rows + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    done = 1
    m = x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:]) if len(m) > done else m[:0]
        done *= 2
    rest = width - done
    if rest:
        m = np.minimum(m[:-rest], m[rest:]) if len(m) > rest else m[:0]
    return m


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: their count, lengths and kinds, then their bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return head + kinds + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unblob(value: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(value, np.int64, 1)[0])
    lengths = np.frombuffer(value, np.int64, n, 8)
    kinds = [value[8 + 8 * n + 4 * i : 12 + 8 * n + 4 * i].decode().strip() for i in range(n)]
    at, out = 8 + 12 * n, []
    for size, kind in zip(lengths.tolist(), kinds):
        out.append(np.frombuffer(value, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out
