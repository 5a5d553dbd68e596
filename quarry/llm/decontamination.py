"""Operator 8: benchmark decontamination by pigeonhole edit matching.

A test item that may differ by e edits is split into e + 1 pieces: a copy with at most e edits holds one of them unchanged, near its place. The
pieces of a block of items are searched for at once by an Aho-Corasick automaton; each hit is verified by Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textops as X
from quarry.llm.line_dedup import save, scratch

#: Edits that count as a copy, as a share of an item's characters.
EDIT_RATE = 0.08
#: Characters of items that one automaton holds, so its memory is bounded; more items are searched for block by block.
BLOCK_CHARS = 2_000_000
#: Workers get a batch's texts in parts of so many bytes.
STEP = 4 << 20

HITS = "doc_id long, t long, item_id long, distance int"

_LOWER = bytes(X.LOWER)


def normal(text: str) -> str:
    """A-Z lowered, runs of blanks as one space, none at the ends."""
    return b" ".join(text.encode().translate(_LOWER).split()).decode()


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of almost equal size with their places."""
    k = min(edits + 1, len(item))
    cuts = [len(item) * i // k for i in range(k + 1)] if k else []
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distance_within(masks: dict[str, int], m: int, text: str, most: int) -> int:
    """Least edit distance between the pattern and any substring of text, or most + 1. One machine word of any width per column (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, most + 1
    get = masks.get
    for c in text:
        eq = get(c, 0)
        vertical = eq | minus
        carry = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(carry | plus) & full
        down = plus & carry
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
    return min(best, most + 1) if best <= most else most + 1


class Matcher:
    """One block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        self.search = ahocorasick.Automaton()
        starts: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not (text := normal(text)):
                continue
            edits = budget(text, rate)
            for at, piece in pieces(text, edits):
                starts.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, peq(text), len(text), edits))
        for piece, places in starts.items():
            self.search.add_word(piece, (len(piece), places))
        self.search.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """item_id and least edit distance of each item that the text holds a copy of."""
        if not self.items:
            return {}
        text = normal(text)
        begins: dict[int, list[int]] = {}
        for end, (size, places) in self.search.iter(text):
            for k, at in places:
                begins.setdefault(k, []).append(end + 1 - size - at)
        found: dict[int, int] = {}
        for k, hits in begins.items():
            item_id, masks, m, edits = self.items[k]
            hits.sort()
            best, i = edits + 1, 0
            while i < len(hits) and best:
                a, b = hits[i] - edits, hits[i]  # hits whose windows overlap are looked at as one, up to a few windows' length
                while i < len(hits) and hits[i] <= b + m and hits[i] - a <= 8 * m:
                    b = hits[i]
                    i += 1
                best = min(best, distance_within(masks, m, text[max(0, a) : b + m + edits], edits))
            if best <= edits:
                found[item_id] = min(best, found.get(item_id, best))
        return found


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items with an id and a text, in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, t (the text's hash), item_id, distance of every item that a text of docs (doc_id, text) holds a copy of.

    Block by block of items: a pass over the texts for each, whose few hits are stored before the next begins, so a worker holds one automaton, whatever the number of items."""
    spark, folder, found = docs.sparkSession, scratch(docs.sparkSession), []
    for k, items in enumerate(item_blocks(benchmark)):
        found.append(save(_block_hits(docs, items, rate), f"{folder}/hits-{k}"))
    if not found:
        return spark.createDataFrame([], HITS)
    return reduce(DataFrame.unionAll, found).groupBy("doc_id", "t", "item_id").agg(F.min("distance").alias("distance"))


def _block_hits(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_CHARS and one item at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(given.value, rate)
        for batch in batches:
            rows, ids, distances = [], [], []
            for a, b in X.steps(X.flat(batch.column(2))[1], STEP):
                for i, text in enumerate(batch.column(2).slice(a, b - a).to_pylist(), a):
                    for item, distance in matcher.matches(text or "").items():
                        rows.append(i)
                        ids.append(item)
                        distances.append(distance)
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(ids, pa.int64()), pa.array(distances, pa.int32())], ["doc_id", "t", "item_id", "distance"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(X.frugal(run), HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, contaminated, n_items, items (their ids in order) and the least distance (null if none) of every row.

    Texts of any length are searched whole. Null and empty texts hold nothing; null and empty items are in no text; an item too short for an edit must be there exactly.
    Repeated rows and null ids give a row each; items with the same id are one, the nearer counts; items with a null id are left out. An empty table gives no row; other columns are
    left out, whatever their names."""
    held = hits(docs, benchmark, rate).groupBy(F.col("doc_id").alias("of"), F.col("t").alias("of_t")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.min("distance").alias("distance"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"))
    both = rows.join(held, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return both.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of docs whose text holds no copy of an item, with their columns, whatever their names; the cases are those of decontaminate()."""
    t, of, of_t = X.fresh(docs, 3)
    held = hits(docs, benchmark, rate).select(F.col("doc_id").alias(of), F.col("t").alias(of_t)).distinct()
    return docs.withColumn(t, F.xxhash64("text")).join(held, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(t) == F.col(of_t)), "left_anti").drop(t)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of benchmark; the cases are those of decontaminate()."""
    return decontaminate(X.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
