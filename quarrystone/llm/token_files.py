"""Token ids in compact binary files: frequency-ranked ids, byte-aligned, control bytes apart from data bytes.

Ids are replaced by their rank by frequency over all documents (ties by id), so frequent ids take one byte. Four ranks
share a control byte (two bits each: bytes less one); the ranks' bytes follow in a stream of their own. Decoding looks
each control byte up in tables of 256 rows (lengths, offsets, total), in numpy, without a loop over ids.

File: magic, then n_docs, n_ids, control bytes, data bytes (u64), doc ids (i64) with a null mask (u8), ids per document
(u64), control stream, data stream. Files hold ranges of ids in ascending order (null first); the vocabulary file lists
ids by rank. Every step names the files it wrote in a manifest; a rerun task writes new ones.

Edge cases: null text is empty and holds only the end id; equal ids keep together, in one file, in the order of their
texts; a text of any length is one document; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, scratch_path, small_batches, stored, table, text_blocks
from quarrystone.llm.files import delete_file, open_file, write_file
from quarrystone.llm.tokens import batch_tokenizer

MAGIC = b"QSIDS\x00\x00\x01"
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)
MANIFEST = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes. The last control byte is filled up with one-byte ranks that have no data."""
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    full = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    full[: len(ranks)] = code
    four = full.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    spread = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, spread[np.arange(4) <= code[:, None]]


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(len(control), np.int64)
    np.cumsum(TOTALS[control[:-1]], out=first[1:])
    at = (first[:, None] + OFFSETS[control]).reshape(-1)[:n]
    length = LENGTHS[control].reshape(-1)[:n]
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    value = padded[at] | padded[at + 1] << 8
    if len(length) and length.max() > 2:
        value |= padded[at + 2] << 16 | padded[at + 3] << 24
    return value & MASKS[length]


def _head(doc_ids: pa.Array, lengths: np.ndarray, n_ids: int, control: int, data: int) -> list[bytes]:
    gone = np.asarray(doc_ids.is_null()).astype(np.uint8)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    sizes = np.array([len(ids), n_ids, control, data], "<u8")
    return [MAGIC, sizes.tobytes(), ids.tobytes(), gone.tobytes(), lengths.astype("<u8").tobytes()]


def _read_head(f) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    got = f.read_at(40, 0)
    if got[:8] != MAGIC:
        raise ValueError("not a token file")
    sizes = np.frombuffer(got, "<u8", 4, 8).astype(np.int64)
    n = int(sizes[0])
    rest = f.read_at(17 * n, 40)
    ids, gone = np.frombuffer(rest, "<i8", n), np.frombuffer(rest, np.uint8, n, 8 * n).astype(bool)
    return pa.array(ids, pa.int64(), mask=gone), np.frombuffer(rest, "<u8", n, 9 * n).astype(np.int64), sizes


def _narrow(ids: np.ndarray) -> np.ndarray:
    """In two bytes an id where all fit."""
    return ids.astype("<u2") if ids.max(initial=0) <= 0xFFFF else ids.astype("<u4")


def _plain_ids(held: bytes, n: int) -> np.ndarray:
    """The first byte is an id's size."""
    raw = pa.decompress(held[1:], n * held[0], codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{held[0]}")


def tokenise_ranges(docs: DataFrame, id: str, text: str, tokenizer: str, end: int, folder: str) -> DataFrame:
    """Plain ids of ascending ranges of documents, a file each; the manifest has (part, uri, n_docs, n_ids)."""

    def run(batches):
        encode = batch_tokenizer(tokenizer, end, keep_space=True).encode
        docs_, lengths, parts = [], [], []
        for batch in pieces(batches, "text"):
            ids, at = encode(batch.column(1))
            docs_.append(batch.column(0)), lengths.append(np.diff(at)), parts.append(_narrow(ids))
        if docs_:
            doc_ids, n, ids = pa.concat_arrays(docs_), np.concatenate(lengths), np.concatenate(parts)
            seen, counts = np.unique(ids, return_counts=True)
            foot = np.stack([seen.astype("<i8"), counts.astype("<i8")]).tobytes()
            held = bytes([ids.itemsize]) + pa.compress(ids.tobytes(), codec="zstd", asbytes=True)
            uri = write_file(folder, "plain", ".ids", [*_head(doc_ids, n, len(ids), len(foot), len(held)), held, foot])
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "uri": [uri], "n_docs": [len(n)], "n_ids": [len(ids)]}, MANIFEST)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(text_blocks(docs, text, 16), F.col("doc").asc_nulls_first())
    return ranged.sortWithinPartitions(F.col("doc").asc_nulls_first(), "text").mapInArrow(run, "part int, uri string, n_docs long, n_ids long")


def _dealt(manifest: DataFrame) -> DataFrame:
    """One file a task or nearly: tasks over a manifest are long and rows are few."""
    return manifest.repartitionByRange(max(8, manifest.count()), "part")


def frequency_ranks(plain: DataFrame) -> np.ndarray:
    """Ids by falling frequency. A task adds up the counts of its files; what comes back is no larger than the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_file(uri) as f:
                    _, _, sizes = _read_head(f)
                    seen, n = np.frombuffer(f.read_at(int(sizes[2]), 40 + 17 * int(sizes[0]) + int(sizes[3])), "<i8").reshape(2, -1)
                if len(seen):
                    total = np.concatenate([total, np.zeros(max(0, int(seen[-1]) + 1 - len(total)), np.int64)])
                    total[seen] += n
        ids = np.flatnonzero(total)
        if len(ids):
            yield pa.RecordBatch.from_pydict({"id": ids, "n": total[ids]})

    counts = plain.select("uri").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()], np.uint32)


def encode_files(plain: DataFrame, ranks_uri: str, folder: str) -> DataFrame:
    """The final files, from the plain ones, which go."""

    def run(batches):
        with open_file(ranks_uri) as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank))
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["uri"]) as f:
                    doc_ids, lengths, sizes = _read_head(f)
                    ids = _plain_ids(f.read_at(int(sizes[3]), 40 + 17 * int(sizes[0])), int(sizes[1]))
                control, data = encode_ranks(rank[ids])
                head = _head(doc_ids, lengths, len(ids), len(control), len(data))
                row["uri"] = write_file(folder, f"ids-{row['part']:06d}", ".qsids", [*head, control.tobytes(), data.tobytes()])
                yield pa.RecordBatch.from_pylist([row], MANIFEST)

    return _dealt(plain).mapInArrow(run, "part int, uri string, n_docs long, n_ids long")


def write_token_files(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """Writes the files; the manifest has (part, uri, n_docs, n_ids, ranks_uri), part ascending with the ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    plain = stored(tokenise_ranges(docs, id, text, tokenizer, end, folder), "ids-plain")
    ranks_uri = write_file(folder, "ranks", ".u32", [frequency_ranks(plain).astype("<u4").tobytes()])
    done = stored(encode_files(plain, ranks_uri, folder), "ids-files")
    for row in plain.select("uri").toLocalIterator():
        delete_file(row["uri"])
    return done.withColumn("ranks_uri", F.lit(ranks_uri))


def read_token_files(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["ranks_uri"]) as f:
                    by_rank = np.frombuffer(f.read(), "<u4")
                with open_file(row["uri"]) as f:
                    doc_ids, lengths, sizes = _read_head(f)
                    n, n_ids, n_control, n_data = sizes.tolist()
                    streams = np.frombuffer(f.read_at(n_control + n_data, 40 + 17 * n), np.uint8)
                at = np.zeros(n + 1, np.int64)
                np.cumsum(lengths, out=at[1:])
                ids = np.empty(n_ids, "<u4")
                low_data = 0
                for low in range(0, n_control, 1 << 18):  # a block at a time: decoding takes many bytes an id
                    control = streams[low : min(low + (1 << 18), n_control)]
                    here = min(4 * len(control), n_ids - 4 * low)
                    taken = int(LENGTHS[control].reshape(-1)[:here].sum())
                    data = streams[n_control + low_data : n_control + low_data + taken]
                    ids[4 * low : 4 * low + here] = by_rank[decode_ranks(control, data, here)]
                    low_data += taken
                cut = at.tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                columns = [doc_ids, pa.array(at[:-1] + row["before"]), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _dealt(manifest.withColumn("before", before)).mapInArrow(run, fields)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), keep_ids=False)
