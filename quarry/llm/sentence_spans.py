"""Operator 7: substring dedup by sliding sentence spans.

Every run of consecutive sentences that just reaches SPAN_SENTENCES sentences and SPAN_WORDS words is hashed, one run from each sentence on. The
hashes are joined globally; the first holder of a span keeps it, and sentences that any later copy covers go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textops as X
from quarry.llm.line_dedup import release, save, scratch

SPAN_SENTENCES = 2
SPAN_WORDS = 12
#: A sentence with more words also ends at commas, colons and semicolons; what is still longer, at words that their hash picks, one of so many.
LONG_WORDS = 24
PICKED = 6

_STOP, _PAUSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_PAUSE[list(b",;:")] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each sentence (and one entry more), its row, where it begins in data, and the hashes of all words.

    A sentence ends at a word that ends in a full stop, exclamation or question mark, before a line feed, and with its row. The bounds inside a long one depend
    on its words alone, so a passage has the same ones in other surroundings."""
    start, end, before = X.words(data, offsets)
    n = len(start)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(1, np.int64), none, none, np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    following = np.append(start[1:], len(data))
    stop = _STOP[data[end - 1]] | (feeds[following] > feeds[end])
    stop[:-1] |= row[1:] != row[:-1]
    stop[-1] = True
    first = np.concatenate([[0], np.flatnonzero(stop) + 1])
    long = np.repeat(np.diff(first) > LONG_WORDS, np.diff(first))
    stop |= long & _PAUSE[data[end - 1]]
    first = np.concatenate([[0], np.flatnonzero(stop) + 1])
    hashes = X.span_hashes(X.LOWER[data], start, end)
    long = np.repeat(np.diff(first) > LONG_WORDS, np.diff(first))
    # A word that the one before equals is a bound too: a run of one word has no other.
    stop |= long & ((X.mix(hashes) % np.uint64(PICKED) == 0) | np.append(False, hashes[1:] == hashes[:-1]))
    first = np.concatenate([[0], np.flatnonzero(stop) + 1])
    return first, row[first[:-1]], start[first[:-1]], hashes


def spans(first: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentence that each span begins with, how many sentences it has, and its hash. Spans stay inside a row."""
    n = len(row)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    at = np.arange(n)
    to = np.maximum(np.searchsorted(first, first[:-1] + SPAN_WORDS, "left"), at + SPAN_SENTENCES)
    ends_row = np.searchsorted(row, row, "right")
    ok = to <= ends_row
    at, to = at[ok], to[ok]
    up, down = X.powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    a, b = first[at], first[to]
    return at, to - at, X.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def span_rows(docs: DataFrame) -> DataFrame:
    """h, k, doc_id, t, pos, n of every span: its hash and a check of 32 bits, its text's id and hash, its first sentence and its sentences."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = X.flat(batch.column(2))
        ids, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        parts = []
        for a, b in X.steps(offsets):
            first, row, _, hashes = sentences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at, n, h = spans(first, row, hashes)
            _, _, check = spans(first, row, X.mix(hashes + X.BASE))
            start_of_row = np.searchsorted(row, np.arange(b - a))
            of = row[at]
            parts.append((h.astype(np.int64), (check >> np.uint64(33)).astype(np.int32), ids[a:b][of], t[a:b][of], (at - start_of_row[of]).astype(np.int32), n.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["h", "k", "doc_id", "t", "pos", "n"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    return X.map_arrow(rows, work, "h long, k int, doc_id long, t long, pos int, n int")


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed and the kept text of every row.

    Of equal spans the one with the smallest doc_id, then the first in its text, is kept. Null and empty texts have no sentence and stay as they
    are, as do rows with a null id, and texts of one sentence or fewer than SPAN_WORDS words, which have no span. Texts of any length are taken whole. Rows with the same id and text
    are one document and lose the same sentences. An empty table gives no row; other columns are left out, whatever their names."""
    found = span_rows(docs)
    owners = found.groupBy("h", "k").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "t", "pos")).alias("first")).where("c > 1").select("h", "k", "first")
    # Stored, so that both sides of the join are plain shuffles, of which Spark splits a span that very many texts hold.
    owners = save(owners, f"{scratch(docs.sparkSession)}/owners")
    release(docs.sparkSession)
    later = found.join(owners, ["h", "k"]).where("NOT (doc_id = first.doc_id AND t = first.t AND pos = first.pos)")
    gone = later.groupBy("doc_id", "t").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("gone.pos").alias("_pos"), F.col("gone.n").alias("_n"))
    both = docs.select("doc_id", "text").join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left").select("doc_id", "text", "_pos", "_n")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, removed = [], [], []
        data, offsets = X.flat(batch.column(1))
        some = batch.column(1).to_pylist()
        pos, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, text in enumerate(some):
            own = data[offsets[i] : offsets[i + 1]]
            first, _, begins, _ = sentences(own, np.array([0, len(own)]))
            out = np.zeros(len(begins), bool)
            for p, k in zip(pos[i] or (), n[i] or (), strict=True):
                out[p : p + k] = True
            if out.any():
                edge = np.append(begins, len(own))
                keep = np.ones(len(own), bool)
                for j in np.flatnonzero(out):
                    keep[edge[j] : edge[j + 1]] = False
                text = own[keep].tobytes().decode()
            texts.append(text)
            total.append(len(begins))
            removed.append(int(out.sum()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])

    return X.map_arrow(both, work, "doc_id long, n_sentences long, n_removed long, text string")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their later copies of spans; the cases are those of dedup_spans()."""
    return dedup_spans(X.documents(spark, sf_dir))
