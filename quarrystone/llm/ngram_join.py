"""n-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of word shingles (64-bit hashes); two link when ``den * shared >= num * union``. A document of n
shingles shares at least T = ceil(num * n / den) with any partner, and the search finds the partners that reach the
required number of occurrences in the inverted lists of its shingles, without ever listing the pairs of a list:

1. Which lists to hold where. With l(n) = 1 + 15 n / 100, linked documents share at least min(l, l') of the shingles among
   their n - ceil(num n / den) + l(n) smallest hashes. Only these go to inverted lists, dealt out by shingle, and a
   document stays in the race only if l(smallest partner) of them are in another text's list too. Its lists are ordered
   by length; without its l - 1 longest, linked documents still share one of the others, and these join the survivors
   into neighbourhoods (components). Documents that merely share a passage or common phrases drop out here.
   In a large corpus chance phrases join ever more of the rest to one neighbourhood. One that is too large for a task is
   split by the same rule over whole sets, in bands of like size: at least T shingles in other texts' lists of the band, and
   without the T - 1 longest still a common one. What stays as large is copies for the most part.
2. T-occurrence search in each neighbourhood, over whole sets. A document's lists are divided: the L longest, by the rule
   of DivideSkip, and the others. The short lists are merged by a heap of their heads; a document that fewer than T - L of
   them hold is never visited (the heap pops T - L - 1 lists and jumps all of them to the next head), and one that T - L
   hold is probed by binary search in the long lists. Documents reaching T are links. A list is ordered by what is
   connected already and then by document, so that, unless all links are asked for, one jump passes a whole connected class.

Hot groups: equal word sequences are one class from the start (a partial aggregate). A shingle that very many documents
hold is not gathered in its list's task: tasks report shingles they see often, and the documents of those that add up go
to tasks by document. A neighbourhood larger than a task should hold is dealt out in chunks, each with the same few pivots;
copies meet through the pivots, and only documents that stay outside the largest class are then searched in every chunk.

Hashes: shingles and word sequences have 64 bits, and equal hashes are taken for equal words.

Edge cases: null text is empty; no words: an empty set, linked with nothing, component = own id; fewer words than a
shingle: the whole sequence is one shingle; equal rows have the same component; rows that share an id but not the text
are documents of their own, with that id; a null id is a document of its own class, after all ids, and comes out null; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.bloom import marked_possible, only_possible
from quarrystone.llm.common import meet, pieces, release, shared_dir, small_batches, stored, table, text_blocks
from quarrystone.llm.words import U, Words, blob, mix, shingle_sets, unblob
from quarrystone.operators.components import connected_components

_NULL_ID = np.iinfo(np.int64).max
#: Shingles a task should hold at most, and pivots of a neighbourhood that is dealt out.
CHUNK, PIVOTS = 200_000, 64
#: Occurrences from which a task reports a shingle, and from which the tasks' reports make it hot; hot ones kept at most
#: (others are dealt out like the rest: the figure is one of balance, not of results).
SEEN, HOT, HOT_KEPT = 32, 2048, 1 << 18
#: Times that large neighbourhoods are split, and the share of a neighbourhood that may stay large for its split to count.
SPLITS, STAYS = 4, 0.9


def _least(n, num: int, den: int):
    """Shingles that any partner of a set of n must share, and the smallest partner's size."""
    return -(-num * n // den)


def _extra(n):
    return 1 + 15 * n // 100


class Prefixes:
    """A batch's texts as sets: ``key`` (hash of the word sequence) and ``n`` by row, and each prefix shingle with its row.
    Of rows with one word sequence only the first has prefix shingles."""

    def __init__(self, texts: pa.Array, k: int, num: int, den: int):
        w = Words(texts, lower=True)
        sets, at = shingle_sets(w, k)
        self.n = n = np.diff(at)
        self.key = w.row_hashes(w.hashes())[:, 0].astype(np.int64)
        once = np.zeros(len(n), bool)
        once[np.unique(self.key, return_index=True)[1]] = True
        take = np.where(once & (n > 0), np.minimum(n, n - _least(n, num, den) + _extra(n)), 0)
        self.row = np.repeat(np.arange(len(n)), take)
        self.tokens = sets[at[self.row] + np.arange(len(self.row)) - np.repeat(np.cumsum(take) - take, take)]


def class_table(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc, raw, key, n) of every row: its id, hash of the text, hash of the word sequence and number of shingles; and, with
    these null, (token, hits) of the prefix shingles that one task sees often."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in pieces(batches, "text"):
            p = Prefixes(batch.column(2), k, num, den)
            tokens, counts = np.unique(p.tokens, return_counts=True)
            again = counts > 1
            for token, count in zip(tokens[again].tolist(), counts[again].tolist()):
                seen[token] = seen.get(token, 0) + count
            if len(seen) > 200_000:
                seen = {t: c for t, c in seen.items() if c >= SEEN}
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.key), pa.array(p.n, pa.int64()), none, none], names=names)
        often = {t: c for t, c in seen.items() if c >= SEEN}
        none = pa.nulls(len(often), pa.int64())
        tokens = np.array(list(often), U).astype(np.int64)
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(tokens), pa.array(list(often.values()), pa.int64())], names=names)

    names = ["doc", "raw", "key", "n", "token", "hits"]
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def hot_tokens(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles, sorted, and how often each was reported."""
    found = classes.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= HOT)
    found = found.orderBy(F.desc("hits"), "token").limit(HOT_KEPT).collect()
    tokens, hits = np.array([r["token"] for r in found], np.int64).astype(U), np.array([r["hits"] for r in found], np.int64)
    order = np.argsort(tokens)
    return tokens[order], hits[order]


def _hits(hot: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """Reported occurrences of each token, 0 if it is not hot."""
    if not len(hot[0]):
        return np.zeros(len(tokens), np.int64)
    spot = np.minimum(np.searchsorted(hot[0], tokens), len(hot[0]) - 1)
    return np.where(hot[0][spot] == tokens, hot[1][spot], 0)


def _blocked(block: np.ndarray, *arrays: np.ndarray):
    """Rows (block, blob of the arrays' parts) of arrays dealt out by block."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    arrays = [a[order] for a in arrays]
    blobs = [blob(*(a[low:high] for a in arrays)) for low, high in zip(cut, np.append(cut[1:], len(block)))]
    return pa.RecordBatch.from_arrays([pa.array(block[cut], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "part"])


BLOCKED = "block int, part binary"


def _gathered(batches, n: int) -> list[np.ndarray]:
    """A block's arrays, each joined from its parts; the parts go as soon as their array is made."""
    release()
    parts = [unblob(value) for batch in batches for value in batch.column(1).to_pylist()]
    if not parts:
        return []
    out = []
    for i in range(n):
        out.append(np.concatenate([p[i] for p in parts]))
        for p in parts:
            p[i] = None
    return out


def _block_of(values: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(values.astype(U)) % U(blocks)).astype(np.int32)


def send_prefixes(rows: DataFrame, blocks: int, k: int, num: int, den: int, hot: tuple) -> DataFrame:
    """Prefix shingles (key, n, token) to their list's block; hot ones, with -n, to their document's."""

    def run(batches):
        for batch in pieces(batches, "text"):
            p = Prefixes(batch.column(2), k, num, den)
            key, n = p.key[p.row], p.n[p.row].astype(np.int32)
            is_hot = _hits(hot, p.tokens) > 0
            block = np.where(is_hot, _block_of(key, blocks), _block_of(p.tokens, blocks))
            yield _blocked(block, key, np.where(is_hot, -n, n), p.tokens)

    return rows.mapInArrow(run, BLOCKED)


def send_sets(rows: DataFrame, blocks: int, k: int, hot: tuple) -> DataFrame:
    """All shingles of rows (text, key, cell), (key, n, token, hits), to their list's block, a cell's lists being its own; hot
    ones, with their hits, to their document's."""

    def run(batches):
        for batch in pieces(batches, "text"):
            sets, at = shingle_sets(Words(batch.column(0), lower=True), k)
            size = np.diff(at)
            key, cell = (np.repeat(batch.column(i).to_numpy(), size) for i in (1, 2))
            hits, tokens = _hits(hot, sets), mix(sets ^ cell.astype(U))
            block = np.where(hits > 0, _block_of(key, blocks), _block_of(tokens, blocks))
            yield _blocked(block, key, np.repeat(size, size).astype(np.int32), tokens, np.minimum(hits, 2**31 - 1).astype(np.int32))

    return rows.mapInArrow(run, BLOCKED)


def repeated_prefixes(sent: DataFrame, blocks: int, hot: tuple | None) -> DataFrame:
    """The shingles in two texts' lists or more go back to their documents with their list's length. Without ``hot``, the hits
    of hot shingles were sent with them."""

    def run(batches):
        got = _gathered(batches, 3 if hot else 4)
        if got:
            key, n, tokens = got[:3]
            length = _hits(hot, tokens) if hot else got[3].astype(np.int64)
            order = np.lexsort((key, tokens))
            key, n, tokens, length = key[order], np.abs(n[order]), tokens[order], length[order]
            del got, order
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (key[1:] != key[:-1])
            key, n, tokens, length = key[new], n[new], tokens[new], length[new]
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            size = np.diff(np.append(first, len(tokens)))
            length = np.where(length > 0, length, np.repeat(size, size))
            keep = length > 1
            key = key[keep]
            yield _blocked(_block_of(key, blocks), key, n[keep], tokens[keep], np.minimum(length[keep], 2**31 - 1).astype(np.int32))
            release()

    return sent.repartition(blocks, "block").mapInArrow(run, BLOCKED)


def short_lists(back: DataFrame, blocks: int, num: int, den: int, whole: bool = False) -> DataFrame:
    """(key, n, token): the short lists of the documents that may have a partner, by prefixes or by ``whole`` sets."""

    def run(batches):
        got = _gathered(batches, 4)
        if got:
            key, n, tokens, length = got
            order = np.lexsort((tokens, length, key))
            key, n, tokens = key[order], n[order], tokens[order]
            del got, length, order
            new = np.ones(len(key), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (key[1:] != key[:-1])
            key, n, tokens = key[new], n[new], tokens[new]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            r = np.diff(np.append(first, len(key)))
            least = _least(n[first].astype(np.int64), num, den)
            keep = np.maximum(0, r - (least if whole else _extra(least)) + 1)
            short = np.arange(len(key)) - np.repeat(first, r) < np.repeat(keep, r)
            yield pa.RecordBatch.from_arrays([pa.array(key[short]), pa.array(n[short], pa.int64()), pa.array(tokens[short].astype(np.int64))], names=["key", "n", "token"])
            release()

    return back.repartition(blocks, "block").mapInArrow(run, "key long, n long, token long")


class TOccurrence:
    """T-occurrence search over sets that come in ascending size: each is searched for among those before, then joins them.

    Inverted lists hold ``class << bits | place``, ascending. ``union``, ``root``: what is connected, by place."""

    def __init__(self, sizes: list[int], num: int, den: int, all_links: bool):
        self.sizes, self.num, self.den, self.all_links = sizes, num, den, all_links
        self.bits = max(1, len(sizes).bit_length())
        self.mask = (1 << self.bits) - 1
        self.parent = list(range(len(sizes)))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def key(self, place: int) -> int:
        return place if self.all_links else self.root(place) << self.bits | place

    def partners(self, q: int, lists: list[list[int]]) -> list[tuple[int, int]]:
        """(place, overlap) of the sets before ``q`` that link with it, from its inverted lists."""
        sizes, num, den, bits = self.sizes, self.num, self.den, self.bits
        size = sizes[q]
        low = bisect_left(sizes, _least(size, num, den))  # smaller sets can't reach the overlap
        if low >= q:
            return []
        t = -(-num * (size + sizes[low]) // (num + den))
        if len(lists) < t:
            return []
        lists.sort(key=len)
        skip = min(t - 1, int(t / (0.0085 * log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        least = t - skip
        heap = [(held[0], j, 0) for j, held in enumerate(short)]
        heapq.heapify(heap)
        out = []

        def jump(popped, bound):
            for _, j, at in popped:
                at = bisect_left(short[j], bound, at)
                if at < len(short[j]):
                    heapq.heappush(heap, (short[j][at], j, at))

        def pop_below(bound):
            popped = []
            while heap and heap[0][0] < bound:
                popped.append(heapq.heappop(heap))
            return popped

        while len(heap) >= least:
            key = heap[0][0]
            place = key & self.mask
            if not self.all_links and self.root(key >> bits) == self.root(q):
                bound = ((key >> bits) + 1) << bits
                jump(pop_below(bound), bound)
                continue
            if place < low:
                bound = key - place + low
                jump(pop_below(bound), bound)
                continue
            popped = pop_below(key + 1)
            count = len(popped)
            if count >= least:
                need = -(-num * (size + sizes[place]) // (num + den))
                if count + skip >= need:
                    left = skip
                    for held in reversed(long):
                        at = bisect_left(held, key)
                        count += at < len(held) and held[at] == key
                        left -= 1
                        if count + left < need:
                            break
                    if count >= need:
                        out.append((place, count))
                        self.union(place, q)
                jump(popped, key + 1)
            else:
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    break
                jump(popped, heap[0][0])
        return out


def divide_skip(ids: np.ndarray, sets: np.ndarray, at: np.ndarray, num: int, den: int, label: np.ndarray | None = None, all_links: bool = False):
    """Links among sets given as CSR of distinct hashes: index pairs and their overlaps.

    ``label``: sets of equal label count as connected. Unless ``all_links``, only links that connect something new are
    sought, and the rest is implied."""
    n = np.diff(at)
    order = np.lexsort((ids, n)).tolist()
    search = TOccurrence(n[order].tolist(), num, den, all_links)
    if label is not None:
        first: dict = {}
        for q, value in enumerate(label[order].tolist()):
            search.union(first.setdefault(value, q), q)
    _, rank, count = np.unique(sets, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    lists: list[list[int]] = [[] for _ in range(int(shared.sum()))]
    held = shared[rank]
    mine, cut = place[rank[held]].tolist(), np.concatenate([[0], np.cumsum(held)])[at].tolist()
    out = []
    for q, i in enumerate(order):
        own = [lists[x] for x in mine[cut[i] : cut[i + 1]]]
        for other, overlap in search.partners(q, [x for x in own if x]):
            out.append((order[other], i, overlap))
        key = search.key(q)
        for x in own:
            insort(x, key)
    return out


def search_chunks(dealt: DataFrame, parts: int, k: int, num: int, den: int, all_links: bool) -> DataFrame:
    """Links (u, v, shared) found in each task's rows (text, key, label, cell); rows of one cell are in one task."""

    def run(batches):
        keys, labels, sets, sizes = [], [], [], []
        for batch in pieces(batches, "text"):
            s, at = shingle_sets(Words(batch.column(0), lower=True), k)
            keys.append(batch.column(1).to_numpy()), sets.append(s), sizes.append(np.diff(at))
            labels.append(batch.column(2).to_numpy())
        if not keys:
            return
        key, label, s, n = (np.concatenate(x) for x in (keys, labels, sets, sizes))
        del keys, labels, sets, sizes
        once = np.zeros(len(n), bool)
        once[np.unique(key, return_index=True)[1]] = True
        s, key, label, n = s[np.repeat(once, n)], key[once], label[once], n[once]
        found = divide_skip(key, s, np.concatenate([[0], np.cumsum(n)]), num, den, label, all_links)
        if found:
            u, v, shared = (np.array(x, np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(key[u]), pa.array(key[v]), pa.array(shared)], names=["u", "v", "shared"])
        release()

    return dealt.select("text", "key", "label", "cell").repartition(parts, "cell").select("text", "key", "label").mapInArrow(run, "u long, v long, shared long")


class JaccardJoin:
    """The join's stages on one table; see the module's text. Texts are known by ``key``, the hash of their word sequence.

    ``rows``: (doc, raw, key, n) of every row; ``classes``: (key, rep, raw, copies), the smallest id, one text and the number of
    rows of each word sequence that has words."""

    def __init__(self, docs: DataFrame, id: str, text: str, k: int, num: int, den: int, chunk: int = CHUNK):
        self.k, self.num, self.den, self.chunk = k, num, den, chunk
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.blocks = text_blocks(docs, text, 8)
        self.texts = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text).alias("raw"), F.col(text).alias("text"))
        held = stored(class_table(self.texts, k, num, den), "join-rows")
        self.hot = hot_tokens(held)
        self.rows = held.where("token is null").select("doc", "raw", "key", "n")
        classes = self.rows.where("n > 0").groupBy("key").agg(F.min("doc").alias("rep"), F.min("raw").alias("raw"), F.count(F.lit(1)).alias("copies"))
        self.classes = stored(classes, "join-classes")

    def neighbourhoods(self) -> DataFrame:
        """(key, hood, n): texts that may have partners, and their neighbourhood."""
        sent = send_prefixes(self.texts, self.blocks, self.k, self.num, self.den, self.hot)
        return self._joined(short_lists(repeated_prefixes(sent, self.blocks, self.hot), self.blocks, self.num, self.den))

    def _joined(self, lists: DataFrame) -> DataFrame:
        """(key, hood, n): documents that share one of the lists (key, n, token) are neighbours."""
        lists = stored(lists, "join-lists")
        heads = lists.groupBy("token").agg(F.min("key").alias("head"), F.max("key").alias("tail")).where("tail > head")
        edges = lists.join(heads, "token").where("key > head").select("key", "head").distinct()
        found = connected_components(edges, shared_dir(self.spark), "key", "head")
        sizes = lists.groupBy("key").agg(F.max("n").alias("n"))
        return stored(found.select(F.col("node").alias("key"), F.col("component").alias("hood")).join(sizes, "key"), "join-hoods")

    def _split(self, large: DataFrame, bands: bool) -> DataFrame:
        """(key, hood, n, was): large neighbourhoods split by whole sets. Documents that link are in the same part, or in the
        same two; sizes that differ by less than the least share are in one band or in bands beside each other, and with
        ``bands`` each document is in its own and the next."""
        width = log(self.den / self.num) * 1.001 + 1e-12
        band = F.floor(F.log("n") / F.lit(width)).cast("long")
        each = F.explode(F.array(band, band + 1) if bands else F.array(F.lit(0).cast("long"))).alias("band")
        dealt = large.select("key", "n", F.col("hood").alias("was"), each).withColumn("cell", F.xxhash64("was", "band")).withColumn("node", F.xxhash64("key", "cell"))
        dealt = stored(dealt.join(self.classes.select("key", "raw"), "key"), "join-split")
        blocks = max(8, int(dealt.agg(F.sum("n").alias("n")).first()["n"]) // (2 * self.chunk))
        texts = only_possible(self.texts, "raw", dealt).groupBy("raw").agg(F.first("text").alias("text"))
        rows = texts.join(dealt.select("raw", "node", "cell").hint("shuffle_hash"), "raw").select("text", "node", "cell")
        back = repeated_prefixes(send_sets(rows, blocks, self.k, self.hot), blocks, None)
        found = self._joined(short_lists(back, blocks, self.num, self.den, whole=True)).select(F.col("key").alias("node"), "hood")
        return found.join(dealt.select("node", "key", "n", "was"), "node").select("key", "hood", "n", "was")

    def _small_hoods(self) -> DataFrame:
        """``neighbourhoods`` in chunks, large ones split as long as that makes them smaller."""
        hoods = stored(self._chunked(self.neighbourhoods()), "join-chunks")
        done, large = hoods.where("chunks = 1"), hoods.where("chunks > 1")
        for i in range(SPLITS):
            if large.isEmpty():
                break
            finer = stored(self._chunked(self._split(large, bands=i == 0), "was"), "join-finer")
            left = finer.where("chunks > 1").groupBy(F.col("was").alias("hood")).agg(F.sum("n").alias("left"))
            gain = large.groupBy("hood").agg(F.sum("n").alias("whole")).join(left, "hood", "left")
            gain = F.broadcast(stored(gain.where(F.coalesce("left", F.lit(0)) < F.lit(STAYS) * F.col("whole")).select("hood"), "join-gain"))  # one row a large neighbourhood
            done = done.unionByName(large.join(gain, "hood", "left_anti"))
            finer = finer.join(gain.withColumnRenamed("hood", "was"), "was", "left_semi").drop("was")
            done, large = done.unionByName(finer.where("chunks = 1")), finer.where("chunks > 1")
        return stored(done.unionByName(large), "join-hoods-small")

    def _chunked(self, hoods: DataFrame, *others: str) -> DataFrame:
        size = hoods.groupBy("hood").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("members"))
        chunks = F.ceil(F.col("_n") / F.lit(self.chunk)).cast("int")
        sized = meet(hoods, size.select("hood", "members", chunks.alias("chunks")), "hood", "members", hoods.count())
        sized = sized.select("key", "n", "hood", "members", "chunks", *others)
        return sized.withColumn("mixed", F.xxhash64("key")).withColumn("chunk", F.pmod("mixed", "chunks").cast("int"))

    def _search(self, dealt: DataFrame, all_links: bool) -> DataFrame:
        """dealt: (key, n, label, cell). One text of each word sequence is fetched, wherever and however often it stands."""
        dealt = stored(dealt.join(self.classes.select("key", "raw"), "key"), "join-dealt")
        texts = only_possible(self.texts, "raw", dealt).groupBy("raw").agg(F.first("text").alias("text"))
        total = dealt.agg(F.sum("n").alias("n")).first()["n"] or 0
        parts = max(8, int(total) // (self.chunk // 2))
        return search_chunks(texts.join(dealt.hint("shuffle_hash"), "raw"), parts, self.k, self.num, self.den, all_links)

    def links(self, all_links: bool = False) -> DataFrame:
        """(u, v, shared): links between texts, by key; enough of them to connect what is connected, or all."""
        hoods = self._small_hoods()
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        pivot = (F.col("chunks") > 1) & (F.shiftrightunsigned("mixed", 1) % F.col("members") < PIVOTS)
        home = hoods.select("key", "n", "hood", "chunk")
        guests = hoods.where(pivot).select("key", "n", "hood", every)
        first = home.unionByName(guests).distinct().select("key", "n", F.xxhash64("hood", "chunk").alias("cell"), F.col("key").alias("label"))
        found = stored(self._search(first, all_links), "join-links")
        large = hoods.where("chunks > 1")
        if large.isEmpty():
            return found.select("u", "v", "shared").distinct()
        comps = connected_components(found, shared_dir(self.spark)).withColumnRenamed("node", "key")
        labelled = stored(large.join(comps, "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component"), "join-labels")
        counted = labelled.groupBy("hood", "label").count().groupBy("hood").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("size"))
        total = labelled.count()
        outside = meet(labelled, counted, "hood", "size", total).where(F.lit(all_links) | (F.col("label") != F.col("most"))).drop("size")
        searched = outside.groupBy("hood").agg(F.ceil(F.sum("n") / F.lit(self.chunk)).cast("int").alias("groups"), F.count(F.lit(1)).alias("size"))
        group = F.pmod(F.shiftrightunsigned("mixed", 7), F.col("groups")).cast("int").alias("group")
        guests = outside.join(searched, "hood").select("key", "n", "hood", "label", group, every)
        each = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")
        home = meet(labelled, searched.withColumn("size", F.col("size") + total), "hood", "size", total).select("key", "n", "hood", "label", each, "chunk")
        second = home.unionByName(guests, allowMissingColumns=True).select("key", "n", "label", F.xxhash64("hood", "chunk", "group").alias("cell")).distinct()
        more = stored(self._search(second, all_links), "join-more-links")
        return found.unionByName(more).select("u", "v", "shared").distinct()

    def decided(self) -> DataFrame:
        """(doc, raw, n, component, winner) of every row; documents without shingles are their own. ``winner``: whether the
        row is of the word sequence that gives its component the id."""
        found = connected_components(self.links(), shared_dir(self.spark)).withColumnRenamed("node", "key")
        linked = found.join(self.classes, "key").select("component", "key", "rep")
        best = linked.groupBy("component").agg(F.min(F.struct("rep", "key")).alias("best"))
        least = stored(found.join(best, "component").select("key", F.col("best.rep").alias("smallest"), F.col("best.key").alias("by")), "join-least")
        groups = self.classes.join(least, "key", "left").select("key", F.coalesce("smallest", "rep").alias("smallest"), F.coalesce("by", "key").alias("by"), "copies")
        known = meet(self.rows.where("n > 0"), groups, "key", "copies", self.rows.count())
        known = known.select("doc", "raw", "n", F.col("smallest").alias("component"), (F.col("key") == F.col("by")).alias("winner"))
        return known.unionByName(self.rows.where("n = 0").select("doc", "raw", "n", F.col("doc").alias("component"), F.lit(True).alias("winner")))


def _real(column: str):
    return F.nullif(F.col(column), F.lit(_NULL_ID))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, chunk: int = CHUNK) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    found = JaccardJoin(docs, id, text, k, num, den, chunk).decided()
    return found.select(_real("doc").alias(id), F.col("n").alias("n_shingles"), _real("component").alias("component_id"))


def jaccard_links(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All links (u, v, shared) between representatives of different texts, and (id, n_shingles, representative) of every row.
    A representative is the smallest id with the text; texts whose smallest ids are the same can't be told apart by it."""
    join = JaccardJoin(docs, id, text, k, num, den, chunk)
    rep = join.classes.select("key", "rep", "copies")
    members = meet(join.rows.where("n > 0"), rep, "key", "copies", join.rows.count()).select("doc", "n", "rep")
    members = members.unionByName(join.rows.where("n = 0").select("doc", "n", F.col("doc").alias("rep")))
    found = join.links(all_links=True)
    for end in ("u", "v"):
        found = found.join(rep.select(F.col("key").alias(end), F.col("rep").alias(f"rep_{end}")), end)
    links = found.select(_real("rep_u").alias("u"), _real("rep_v").alias("v"), "shared")
    return links, members.select(_real("doc").alias(id), F.col("n").alias("n_shingles"), _real("rep").alias("representative"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their component and are of the text that gives it.
    Rows that repeat both stay together; null and empty texts stay. A row is known by its id and a hash of its text, and
    only rows that a filter of those to go may hold meet them."""
    found = JaccardJoin(docs, id, text, k, num, den).decided().where((F.col("doc") != F.col("component")) | ~F.col("winner"))
    gone = stored(found.select(F.xxhash64("doc", "raw").alias("_x_gone")).distinct(), "join-gone")
    row = F.xxhash64(F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID)), F.xxhash64(text))
    marked = marked_possible(docs.withColumn("_x_gone", row), "_x_gone", gone)
    stays = marked.where("_x_again").join(gone, "_x_gone", "left_anti")
    return marked.where("not _x_again").select(docs.columns).unionByName(stays.select(docs.columns))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM d),
n AS (SELECT d.doc_id, count(shingle) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, l.v FROM r JOIN l ON r.reached = l.u)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id
FROM n JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) c ON c.node = n.doc_id
"""
