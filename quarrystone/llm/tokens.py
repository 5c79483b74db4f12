"""Token ids of whole texts in batches, with each distinct piece of text encoded once.

A text is cut before every run of ASCII white space, and each distinct cut is encoded once and its ids gathered. That
equals encoding the whole text: both vocabularies split at white space before they merge, so no token crosses a cut.
Where the split keeps white space (``keep_space``), a text holding any other Unicode white space is encoded uncut.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from quarrystone.llm.common import worker_own
from quarrystone.llm.words import Words

#: Distinct cuts that a worker keeps, about 60 bytes each; past it the worker starts anew.
_CACHED_UNITS = 1_000_000
_RECENT = 100_000


def batch_tokenizer(path: str, end: int | None, keep_space: bool) -> BatchTokenizer:
    """The worker's own, kept from task to task."""
    return worker_own(("tokens", path, end, keep_space), lambda: BatchTokenizer(path, end, keep_space))


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII, in UTF-8: U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    a = data[:-2]
    lead = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
    three = np.flatnonzero((a == 0xE1) | (a == 0xE2) | (a == 0xE3))
    b, c, a = data[three + 1], data[three + 2], a[three]
    e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    other = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return np.concatenate([lead, three[e2 | other]])


class BatchTokenizer:
    """``encode(texts)``: ids of all texts and their CSR offsets. ``end``: an id added to each text."""

    def __init__(self, path: str, end: int | None, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.keep_space = Tokenizer.from_file(path), end, keep_space
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.recent: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each (sorted) hash in the cache, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[spot] == hashes
            out[hit] = self.places[spot[hit]]
        if self.recent:
            rest = np.flatnonzero(out < 0)
            out[rest] = [self.recent.get(k, -1) for k in hashes[rest].tolist()]
        return out

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        low = int(self.at[self.n])
        ends = low + np.cumsum(n)
        top = int(ends[-1])
        while top > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(ids) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[low:top] = np.fromiter(chain.from_iterable(ids), np.uint32, top - low)
        self.at[self.n + 1 : self.n + 1 + len(ids)] = ends
        places = np.arange(self.n, self.n + len(ids))
        self.n += len(ids)
        self.recent.update(zip(hashes.tolist(), places.tolist()))
        if len(self.recent) > _RECENT:
            keys = np.concatenate([self.keys, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
            spots = np.concatenate([self.places, np.fromiter(self.recent.values(), np.int64, len(self.recent))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.places, self.recent = keys[order], spots[order], {}
        return places

    def _units(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and CSR offsets by text of the cuts."""
        if not self.keep_space:
            return w.starts, w.ends, w.off
        first = np.zeros(len(w), bool)
        first[w.off[:-1][w.counts > 0]] = True
        rows = w.row_of_words()
        starts = np.empty(len(w), np.int64)
        starts[1:] = w.ends[:-1]
        starts[first] = w.at[:-1][rows[first]]
        last = np.where(w.counts > 0, w.ends[np.maximum(w.off[1:] - 1, 0)] if len(w) else 0, w.at[:-1])
        tail = np.flatnonzero(last < w.at[1:])
        starts, ends = np.concatenate([starts, last[tail]]), np.concatenate([w.ends, w.at[1:][tail]])
        rows = np.concatenate([rows, tail])
        odd = _odd_space(w.data)
        if len(odd):
            whole = np.unique(np.searchsorted(w.at, odd, "right") - 1)
            keep = ~np.isin(rows, whole)
            starts, ends = np.concatenate([starts[keep], w.at[whole]]), np.concatenate([ends[keep], w.at[whole + 1]])
            rows = np.concatenate([rows[keep], whole])
        order = np.lexsort((starts, rows))
        return starts[order], ends[order], np.searchsorted(rows[order], np.arange(w.rows + 1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = Words(texts)
        starts, ends, off = self._units(w)
        hashes, where, back = np.unique(w.hashes(starts, ends), return_index=True, return_inverse=True)
        if self.n + len(hashes) > _CACHED_UNITS:
            self._clear()
        got = self._find(hashes)
        new = np.flatnonzero(got < 0)
        held = w.data.tobytes() if len(new) else b""
        for low in range(0, len(new), 8192):
            part = new[low : low + 8192]
            s, e = starts[where[part]].tolist(), ends[where[part]].tolist()
            encoded = self.tokenizer.encode_batch_fast([held[a:b].decode() for a, b in zip(s, e)], add_special_tokens=False)
            got[part] = self._add(hashes[part], [x.ids for x in encoded])
        unit = got[back.reshape(-1)]
        begin = self.at[unit]
        length = self.at[unit + 1] - begin if len(unit) else begin
        sums = np.zeros(len(unit) + 1, np.int64)
        np.cumsum(length, out=sums[1:])
        spots = np.arange(sums[-1]) + np.repeat(begin - sums[:-1], length)
        ids, at = self.ids[spots], sums[off]
        if self.end is None:
            return ids, at
        out = np.full(len(ids) + w.rows, self.end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[at[1:] + np.arange(w.rows)] = False
        out[keep] = ids
        return out, at + np.arange(w.rows + 1)
