"""WARC records in ZIP-packaged archives, written and range-read by tasks.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (each record its own gzip
member) and ``indexes/index.cdx`` (page id, type, offset and length in the member, URL, by line). The reader takes the
end record, the ZIP64 locator and directory where sizes need them, the central directory and the members' local headers
by range, then the index, then the records by their ranges; nothing is extracted. Records go to the archive's stream as they
are made, and archives close at about 32 MB; the reader gives its rows on by a few megabytes. So a task holds a record, an
index and a batch, not an archive.

Deduplication: of payloads equal by SHA-256 and at least ``least`` bytes long, the record of the smallest page id is a
response and the others revisit it. Winners are a partial aggregate, large groups meet theirs by broadcast, and only pages
that a filter of the revisits may hold shuffle with their html.

Edge cases: null html is an empty payload; smaller payloads are all responses; a repeated page id with an equal payload is
no revisit of itself; a null page id is written as an empty id, after all others, and comes back null; null URLs come back
null; line ends in URLs are percent-encoded; html of any size is one record; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.bloom import marked_possible
from quarrystone.llm.common import meet, pieces, scratch_path, small_batches, stored, table
from quarrystone.llm.files import open_file, place

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ROLL = 32 << 20
_NULL_ID = (1 << 63) - 1


def _record(kind: str, page: str, url: str | None, payload: bytes, digest: str, refers: str, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def packed(members: dict[str, bytes]) -> bytes:
    """A ZIP file of stored members."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


class Archive:
    """An archive as it is written: records go straight to the file, the index follows them."""

    def __init__(self, folder: str):
        system, path = place(folder)
        system.create_dir(path, recursive=True)
        name = f"pages-{uuid.uuid4().hex[:12]}.wacz"
        self.uri, self.out = f"{folder}/{name}", system.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.size = [], 0

    def add(self, page: str, kind: str, url: str | None, record: bytes) -> None:
        self.data.write(record)
        self.index.append(f"{page} {kind} {self.size} {len(record)} {(url or '-').split(chr(10))[0]}\n")
        self.size += len(record)

    def close(self) -> pa.RecordBatch:
        """The manifest's row."""
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.out.close()
        return pa.RecordBatch.from_pydict({"uri": [self.uri], "records": pa.array([len(self.index)], pa.int64())})


def members(f) -> dict[str, tuple[int, int]]:
    """Offset and size of the stored members of a ZIP file opened for ranges, from its directories alone."""
    size = f.size()
    tail_at = max(0, size - 65557 - 20)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = f.read_at(56, at)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = f.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed_size, whole, n, extra, comment, local = *struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<IIHHH", directory, at + 20), *struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode()
        field, stop = at + 46 + n, at + 46 + n + extra
        while field + 4 <= stop:
            kind, k = struct.unpack_from("<HH", directory, field)
            if kind == 1:  # ZIP64: only the values that didn't fit, in this order
                place = field + 4
                if whole == 0xFFFFFFFF:
                    (whole,), place = struct.unpack_from("<Q", directory, place), place + 8
                if packed_size == 0xFFFFFFFF:
                    (packed_size,), place = struct.unpack_from("<Q", directory, place), place + 8
                if local == 0xFFFFFFFF:
                    (local,) = struct.unpack_from("<Q", directory, place)
            field += 4 + k
        at += 46 + n + extra + comment
        if method == 0:
            head = f.read_at(30, local)
            n, extra = struct.unpack_from("<HH", head, 26)
            found[name] = local + 30 + n + extra, packed_size
    return found


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives; the manifest has (uri, records)."""
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.coalesce(F.col(id).cast("long"), F.lit(_NULL_ID)).alias("page"), F.col(url).cast("string").alias("url"), body.alias("html"))
    digests = stored(rows.select("page", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")), "archive-digests")
    large = digests.where(F.col("size") >= least).select("page", "digest")
    groups = large.groupBy("digest").agg(F.min("page").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = meet(large, stored(groups, "archive-groups"), "digest", "n", digests.count()).where("page <> refers")
    revisits = stored(revisits.select(F.struct("page", "digest").alias("row"), "refers").distinct(), "archive-revisits")
    own = rows.withColumn("digest", F.sha2("html", 256)).withColumn("row", F.struct("page", "digest"))
    marked = marked_possible(own, "row", revisits)
    columns = ["page", "url", "html", "digest", "refers"]
    joined = marked.where("_x_again").join(revisits, "row", "left").select(columns)
    joined = marked.where("not _x_again").withColumn("refers", F.lit(None).cast("long")).select(columns).unionByName(joined)

    def text(n: int) -> str:
        return "" if n == _NULL_ID else str(n)

    def run(batches):
        archive = None
        for batch in pieces(batches, "html"):
            for page, link, held, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or Archive(folder)
                kind = "response" if refers is None else "revisit"
                record = _gzip(_record(kind, text(page), link, held.encode(), digest, text(refers) if refers is not None else "", date))
                archive.add(text(page), kind, link, record)
                if archive.size >= ROLL:
                    yield archive.close()
                    archive = None
        if archive is not None:
            yield archive.close()

    return stored(joined.mapInArrow(run, "uri string, records long"), "archive-manifest")


def parse_record(data: bytes) -> dict:
    """A record's headers and payload."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return {"fields": fields, "payload": payload, "payload_bytes": size}


def read_archives(manifest: DataFrame, payloads: bool = True, window: int = 4 << 20) -> DataFrame:
    """One row a record, from the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest (and html).
    A response's length and digest are taken of the payload read; a revisit has those of the payload it stands for."""
    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", html string" * payloads

    def page(value: str | None) -> int | None:
        held = (value or "")[len("<urn:page:") : -1]
        return int(held) if held else None

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"][: 6 + payloads]

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    def entries(f, at: int, size: int):
        """Offset and length of each record, by the index, a window of it at a time."""
        rest, stop = b"", at + size
        while at < stop:
            part = f.read_at(min(window, stop - at), at)
            at += len(part)
            *lines, rest = (rest + part).split(b"\n")
            for line in lines:
                _, _, offset, length, _ = line.split(b" ", 4)
                yield int(offset), int(length)

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_file(uri) as f:
                    found = members(f)
                    base, _ = found[DATA]
                    out, gathered, low, held = [], 0, 0, b""
                    for offset, length in entries(f, *found[INDEX]):
                        if offset + length > low + len(held):
                            low, held = offset, f.read_at(max(window, length), base + offset)
                        record = parse_record(zlib.decompress(held[offset - low : offset - low + length], 31))
                        fields_, payload = record["fields"], record["payload"]
                        revisit = fields_["WARC-Type"] == "revisit"
                        digest = fields_["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        row = [page(fields_["WARC-Record-ID"]), fields_.get("WARC-Target-URI"), fields_["WARC-Type"], page(fields_.get("WARC-Refers-To")) if revisit else None, record["payload_bytes"] if revisit else len(payload), digest]
                        out.append(row + [None if revisit else payload.decode()] if payloads else row)
                        gathered += 200 + len(payload) * payloads
                        if gathered >= window:
                            yield made(out)
                            out, gathered = [], 0
                    if out:
                        yield made(out)

    return manifest.select("uri").repartitionByRange(max(8, manifest.count()), "uri").mapInArrow(run, fields)


def op3_warc_archives(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
