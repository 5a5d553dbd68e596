"""Operator 9: document fingerprints from prefix polynomial hashes.

The prefix sums of c[i] * B ** i under two prime moduli give the hash of any span in constant time, so spans of one or two texts are compared
without their characters, and the longest common extension of two places is found by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textops as X

#: Prime moduli and bases.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 92821)
#: Bytes of the spans that a fingerprint samples, and how many of their hashes it holds.
SPAN = 12
SKETCH = 48
#: Characters of texts whose prefix arrays are made at once, unless one text has more.
STEP = 1 << 20


class _Powers:
    def __init__(self, k: int):
        self.p, self.base = MODULI[k], BASES[k]
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m, p = len(self.up), self.p
            grown = []
            for table, base in ((self.up, self.base), (self.down, pow(self.base, -1, p))):
                grown.append(np.concatenate([table, table * np.uint64(pow(base, m, p)) % np.uint64(p)]))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


@lru_cache(2)
def _powers(k: int) -> _Powers:
    return _Powers(k)


class PrefixHashes:
    """Prefix arrays of a string of bytes; of several texts one after another, spans that stay inside one are that text's."""

    def __init__(self, data: bytes):
        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.n = len(values)
        self.sums = []
        for k, p in enumerate(MODULI):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * _powers(k).to(self.n + 1)[0][:-1] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of data[start:end]; equal spans have equal ones wherever they stand."""
        out = np.zeros(len(start), np.uint64)
        for k, p in enumerate(MODULI):
            down = _powers(k).to(self.n + 1)[1]
            out = (out << np.uint64(31)) | ((self.sums[k][end] + np.uint64(p) - self.sums[k][start]) % np.uint64(p) * down[start] % np.uint64(p))
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def equal(self, at: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans of these sizes from at and from there on are equal; all of them are inside."""
        return self.spans(at, at + size) == self.spans(there, there + size)

    def common_extension(self, at: np.ndarray, there: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many bytes from at and from there on are equal, at most so many; back: how many before them. One binary search for all pairs."""
        low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(at - middle, there - middle, middle) if back else self.equal(at, there, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


class Fingerprints:
    """Fingerprints of texts, and how like two of them are, all from the prefix arrays of the texts one after another."""

    def __init__(self, texts: list[bytes]):
        self.at = np.cumsum([0, *map(len, texts)])
        self.hashes = PrefixHashes(b"".join(texts))
        starts = np.arange(max(self.hashes.n - SPAN + 1, 0))
        mixed = X.mix(self.hashes.spans(starts, starts + SPAN)) >> np.uint64(32)
        self.sampled = [self._sample(mixed, int(a), int(b)) for a, b in zip(self.at, self.at[1:], strict=False)]

    def _sample(self, mixed: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest mixed hashes of a text's spans, and a place of each; a text shorter than a span is one span."""
        if b - a < SPAN:
            return (X.mix(self.hashes.spans(np.array([a]), np.array([b]))) >> np.uint64(32), np.array([a])) if b > a else (mixed[:0], np.zeros(0, np.int64))
        own = mixed[a : b - SPAN + 1]
        few = np.arange(len(own))
        if len(own) > 8 * SKETCH:  # the smallest values, with room for equal ones
            few = np.sort(np.argpartition(own, 4 * SKETCH)[: 4 * SKETCH])
            if len(np.unique(own[few])) < SKETCH:
                few = np.arange(len(own))
        values, first = np.unique(own[few], return_index=True)
        return values[:SKETCH], a + few[first[:SKETCH]]

    def mark(self, i: int) -> str:
        """Size and hash of the whole, and the sampled hashes."""
        a, b = int(self.at[i]), int(self.at[i + 1])
        return f"{b - a:x}.{self.hashes.span(a, b):016x}." + "".join(f"{x:08x}" for x in self.sampled[i][0].tolist())

    def likeness(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """Of each pair of texts: the share of their bytes that the common extensions of their fingerprints' common spans cover, 1 for equal texts, 0 if one alone is empty.

        The spans that both fingerprints sample, and the two begins, are extended both ways as far as the texts are equal; the less covered text counts."""
        x, y, of = [], [], []
        for k, (i, j) in enumerate(pairs):
            _, a, b = np.intersect1d(self.sampled[i][0], self.sampled[j][0], assume_unique=True, return_indices=True)
            x.append(np.append(self.sampled[i][1][a], self.at[i]))
            y.append(np.append(self.sampled[j][1][b], self.at[j]))
            of.append(np.full(len(a) + 1, k))
        if not pairs:
            return np.zeros(0)
        x, y, of = (np.concatenate(c).astype(np.int64) for c in (x, y, of))
        ends, begins = self.at[1:], self.at[:-1]
        i, j = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        ahead = self.hashes.common_extension(x, y, np.minimum(ends[i[of]] - x, ends[j[of]] - y))
        back = self.hashes.common_extension(x, y, np.minimum(x - begins[i[of]], y - begins[j[of]]), back=True)
        size, other = ends[i] - begins[i], ends[j] - begins[j]
        covered = np.minimum(_covered(of, x - back, x + ahead, len(pairs)), _covered(of, y - back, y + ahead, len(pairs)))
        return np.where(size + other > 0, 2 * covered / np.maximum(size + other, 1), 1.0)


def _covered(of: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Bytes that the spans of each number cover together."""
    by = np.lexsort((start, of))
    of, start, end = of[by], start[by], end[by]
    lift = of * (int(end.max(initial=0)) + 1)  # each number's spans begin behind those of the one before
    reach = np.maximum.accumulate(end + lift)
    before = np.append(0, reach[:-1])
    new = np.maximum(end + lift - np.maximum(start + lift, before), 0)
    return np.bincount(of, new, n)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """bucket, own, doc_id, text: documents in ranges of ids, each range with the document after its last one (own false) in descending order.

    Rows are ordered by doc_id descending, then by a hash of the text; null ids come last; after the last row comes the first. Only one
    id for each range goes to the driver."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text")
    edges = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("e")).first().e or []
    edges = sorted(set(edges))
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<bigint>"), lambda e: e < F.col("doc_id")))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket))
    tops = [(r.bucket, r.top) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy(F.desc("bucket")).collect()]
    if not tops:
        return rows.select("bucket", F.lit(True).alias("own"), "doc_id", "text")
    pairs = [(tops[(i + 1) % len(tops)][1], bucket) for i, (bucket, _) in enumerate(tops)]
    after = spark.createDataFrame(pairs, "top long, for_bucket int")
    lent = rows.drop("bucket").join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("top"))).select(F.col("for_bucket").alias("bucket"), F.lit(False).alias("own"), "doc_id", "text")
    return rows.select("bucket", F.lit(True).alias("own"), "doc_id", "text").unionAll(lent)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty, and so is an empty text's edited text; two empty texts are alike. A text of any length is taken whole. A single row is its own next document. Repeated rows and
    ids are documents of their own, next to each other, ordered by a hash of the text; null ids come last. An empty table gives no row. Input columns other than doc_id and text are
    left out, whatever their names."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs, parts).withColumn("t", F.xxhash64("text")).repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), "t")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def made(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        """rows: id, text and the next document's text."""
        data, at, last = [], [], None
        for _, t, after in rows:
            if t is not last:  # most often the row before has had it as its next
                data.append(t.encode())
            here = len(data) - 1
            data += [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode(), after.encode()]
            at.append((here, len(data) - 2, len(data) - 1))
            last = after
        f = Fingerprints(data)
        columns = [
            [i for i, _, _ in rows], [len(t) for _, t, _ in rows], [hashlib.sha256(data[e]).hexdigest() for _, e, _ in at], [f.mark(k) for k, _, _ in at], [f.mark(e) for _, e, _ in at],
            f.likeness([(k, e) for k, e, _ in at]), f.likeness([(k, n) for k, _, n in at]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row that waits for its next one
        rows: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for bucket, own, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if before and before[0] == bucket:
                    rows.append((before[1], before[2], text or ""))
                    size += len(before[2]) + len(text or "")
                    if size >= STEP:
                        yield made(rows)
                        rows, size = [], 0
                before = (bucket, doc_id, text or "") if own else None
        if rows:
            yield made(rows)

    return dealt.select("bucket", "own", "doc_id", "text").mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with the next one; the cases are those of fingerprints()."""
    return fingerprints(X.documents(spark, sf_dir))
