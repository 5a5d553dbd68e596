"""Vectorised text helpers shared by the corpus operators: Arrow text columns as one byte array, n-gram and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = b" \t\n\x0b\x0c\r"
#: Odd multipliers of the 64-bit hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 4 << 20
#: Bytes of labelled texts of each class that a classifier is trained on at most.
SAMPLE_BYTES = 4 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(rows: DataFrame, n: int) -> list[str]:
    """n column names that rows doesn't have, in upper or lower case."""
    taken, out, k = {c.lower() for c in rows.columns}, [], 0
    while len(out) < n:
        if (name := f"_q{k}") not in taken:
            out.append(name)
        k += 1
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and where each begins (one more entry for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if big else np.int32, len(column) + 1, column.offset * (8 if big else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows one after another, A-Z lowered, and where each row begins; bytes that aren't UTF-8 are one odd character each."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        points, at = data.astype(np.uint32) + np.where(data < 128, 0, 0x110000).astype(np.uint32), np.arange(len(data) + 1)
    return np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64), at[offsets]


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without white space, inside one row), and how many words stand before each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of data[start:end] for each pair, mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def hand_back() -> None:
    """What this worker has freed goes back to the system, and powers() with it. Workers live on from task to task, so it would count beside what the next stage takes."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, which hands its memory back at the end of a task."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        hand_back()

    return whole


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """One Arrow batch in, one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most per_class labelled texts of each class and most_bytes of them, whole texts, those with the smallest hash of the id that fit; never a held-out row.

    Of several labels of an id the largest counts, of several texts the one with the smallest hash. The ids are at most 2 * per_class, so they are
    broadcast; the texts are what the caller trains on in the driver."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.where("y = 0").orderBy(*order).limit(per_class).unionAll(rows.where("y = 1").orderBy(*order).limit(per_class))
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("t"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    found = given.drop("text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("t", "size")).alias("one"))
    left, chosen = {0: most_bytes, 1: most_bytes}, {}
    for r in found.select("doc_id", "y", "one.t", "one.size", F.xxhash64("doc_id").alias("o")).orderBy("o", "doc_id").collect():
        if r.size <= left[r.y]:
            left[r.y] -= r.size
            chosen[r.doc_id] = (r.t, r.y)
    # As an Arrow table: a list would go through Python workers of another kind, which stay beside those of the stages.
    columns = [pa.array(list(chosen), pa.int64()), pa.array([t for t, _ in chosen.values()], pa.int64()), pa.array([y for _, y in chosen.values()], pa.int32())]
    wanted = docs.sparkSession.createDataFrame(pa.table(columns, ["doc_id", "t", "y"]))
    got = given.join(F.broadcast(wanted), ["doc_id", "t"]).select("doc_id", "text", "y").dropDuplicates(["doc_id"]).collect()
    return [(r.text or "", r.y) for r in sorted(got, key=lambda r: r.doc_id)]
