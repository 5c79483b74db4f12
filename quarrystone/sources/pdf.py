"""PDF files: pages, text and the information dictionary, by a small parser of our own over Arrow batches of files.

It reads classic and compressed object streams, Flate and plain content and simple fonts. Encrypted files, other filters and
composite fonts give no text. A file that can't be parsed gives nulls; it is never dropped.
"""

from __future__ import annotations

import json
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, pages long, text string, title string, author string, creator string, producer string, created string, modified string, info string"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OBJ = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\[(.*?)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|(?:Td|TD|Tm|ET)\b)", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)


def _decoded(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode() + "0" * (len(re.sub(rb"[^0-9A-Fa-f]", b"", raw)) % 2))
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], m[1].strip(b"\r\n"))
        data = re.sub(rb"\\([0-7]{1,3}|.|\n)", octal, raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _unpacked(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"FlateDecode" not in body[: found.start()]:
        return b"" if b"/Filter" in body[: found.start()] else found[1]
    try:
        return zlib.decompressobj().decompress(found[1])
    except zlib.error:
        return b""


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJ.finditer(data)}
    for body in [b for b in found.values() if b"/ObjStm" in b]:
        inner, first = _unpacked(body), re.search(rb"/First\s+(\d+)", body)
        if inner and first:
            start = int(first[1])
            heads = [int(x) for x in inner[:start].split()]
            places = heads[1::2] + [len(inner) - start]
            for k, number in enumerate(heads[::2]):
                found.setdefault(number, inner[start + places[k] : start + places[k + 1]])
    return found


def _shown(content: bytes) -> str:
    out: list[str] = []
    for many, single, move in _SHOWN.findall(content):
        if move:
            if out and out[-1] != "\n":
                out.append("\n")
        else:
            out.extend(_decoded(s) for s in _STRING.findall(many or single))
    return "".join(out).strip()


def parse(data: bytes) -> dict | None:
    """Pages, text (pages joined by a line end, in page order) and information of one file; null if it is no PDF."""
    if data[:1024].find(b"%PDF-") < 0:
        return None
    objects = _objects(data)
    order: list[int] = []

    def walk(number: int, seen: set[int]) -> None:
        body = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            for kid in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                walk(int(kid), seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            order.append(number)

    seen: set[int] = set()
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    for number in sorted(roots) or sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)):
        walk(number, seen)
    pages = []
    for number in order:
        held = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[number], re.S)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", held[1]) if held else []
        pages.append(_shown(b"\n".join(_unpacked(objects.get(int(r), b"")) for r in refs)))
    info: dict[str, str] = {}
    at = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    if at:
        for key, value in re.findall(rb"/(\w+)\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", objects.get(int(at[-1]), b""), re.S):
            info[key.decode()] = _decoded(value)
    return {"pages": len(order), "text": "\n".join(pages), "info": info}


def read_pdfs(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """A row per file of ``SCHEMA``; dates stay as written (``D:...``), ``info`` is the whole dictionary as JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches):
        for part in batches:
            rows = []
            for path, data in zip(part["path"], part["content"]):
                try:
                    got = parse(bytes(data))
                except (ValueError, IndexError, KeyError, RecursionError):
                    got = None
                info = got["info"] if got else {}
                rows.append((path, got and got["pages"], got and got["text"], *(info.get(k) for k in ("Title", "Author", "Creator", "Producer", "CreationDate", "ModDate")), json.dumps(info, sort_keys=True) if got else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"pages": "Int64"})

    return files.mapInPandas(run, SCHEMA)


def extract_texts(spark: SparkSession, folder: str, out: str, force: bool = False, dry_run: bool = False) -> DataFrame:
    """Texts of the files not yet in ``out`` (all with ``force``), appended there as Parquet unless ``dry_run``; returns what was due."""
    from quarrystone.sources.store import exists

    due = read_pdfs(spark, folder).select("path", "pages", "text")
    if not force and exists(spark, out):
        due = due.join(spark.read.parquet(out).select("path"), "path", "left_anti")
    if not dry_run:
        due.write.mode("overwrite" if force else "append").parquet(out)
    return due
