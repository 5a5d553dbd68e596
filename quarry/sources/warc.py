"""WARC/1.0 records of any number of files; one file is one task's, as multistream gzip can't be split."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_PAYLOAD = 64 << 20
SCHEMA = "file STRING, arrival BIGINT, type STRING, url STRING, date STRING, text STRING"


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lowered) and payload of each record; a payload beyond the limit or cut short is an error."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:20]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().strip()):
            name, _, value = line.partition(b":")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        size = int(headers["content-length"])
        if not 0 <= size <= MAX_PAYLOAD:
            raise ValueError(f"a payload of {size} bytes")
        payload = stream.read(size)
        if len(payload) < size:
            raise ValueError("the last record is cut short")
        yield headers, payload


def rows_of(name: str, content: bytes) -> Iterator[tuple]:
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    for i, (h, payload) in enumerate(records(io.BufferedReader(stream))):
        yield name, i, h.get("warc-type", ""), h.get("warc-target-uri", ""), h.get("warc-date", ""), payload.decode("utf-8", "replace")


#: Bytes of texts or files that are put together before they go on.
PART_BYTES = 8 << 20


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of batches of path, content. One file's content is held as Python's at a time, and PART_BYTES of texts."""
    names = ["file", "arrival", "type", "url", "date", "text"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
    held, size = [], 0

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            for row in rows_of(name.as_py(), content.as_py()):
                held.append(row)
                size += len(row[5])
                if size > PART_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
    if held:
        yield batch_of(held)


def parsed(files: DataFrame) -> DataFrame:
    """Records of files (path, content): the file, the record's place in it, type, url, date, text."""
    return files.select("path", "content").mapInArrow(parse, SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below a path that Spark reads; one task for each file."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def record(kind: str, url: str, date: str, text: str) -> bytes:
    """One record as a gzip member."""
    body = text.encode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n")


def write_warc(rows: list[dict], path: str) -> None:
    """One file; for tests and small exports."""
    with open(path, "wb") as f:
        for r in rows:
            f.write(record(r["type"], r["url"], r.get("date", ""), r["text"]))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content of the files of sorted batches. Rows are taken out of Arrow one at a time, and files go on as soon as they have PART_BYTES."""
    name, held, done, size = None, [], [], 0

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in done]), pa.array([c for _, c in done], pa.binary())], ["path", "content"])

    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            file, _, *fields = (c.as_py() for c in row)
            if file != name and held:
                done.append((name, b"".join(held)))
                size += len(done[-1][1])
                held = []
                if size > PART_BYTES:
                    yield batch_of(done)
                    done, size = [], 0
            name = file
            held.append(record(*(f or "" for f in fields)))
    if held:
        done.append((name, b"".join(held)))
    if done:
        yield batch_of(done)


def packed(rows: DataFrame) -> DataFrame:
    """path, content: rows (file, at, type, url, date, text) as WARC files, each file's records in order of at. A file is a unit, so its rows should be few."""
    return rows.select("file", "at", "type", "url", "date", "text").repartition("file").sortWithinPartitions("file", "at").mapInArrow(pack, "path string, content binary")
