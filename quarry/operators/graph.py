"""Link graph, docmap and near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import fingerprint, simhash64
from quarry.sources.stored import saved


def edges(outlinks: DataFrame) -> DataFrame:
    """Distinct src, dst."""
    return outlinks.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def adjacency(edge_rows: DataFrame) -> DataFrame:
    """src with its sorted distinct dsts."""
    return edge_rows.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))


def walk(adjacent: DataFrame) -> DataFrame:
    """Edges in order of ids."""
    return adjacent.select("src", F.explode("dsts").alias("dst")).orderBy("src", "dst")


def degrees(edge_rows: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    both = edge_rows.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edge_rows.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def graph_stats(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.agg(F.countDistinct("src").alias("n_src"), F.count(F.lit(1)).alias("n_edges"), F.min("src").alias("first"), F.max("src").alias("last"))


def in_degree_of_pages(outlinks: DataFrame, pages: DataFrame) -> DataFrame:
    """urlfp and in-degree of the pages that are linked to; links are resolved by fingerprint, which outlives generations."""
    counts = outlinks.select("dst").groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))
    return pages.select("urlfp").join(counts, F.col("urlfp") == F.col("dst")).select("urlfp", "in_degree")


def docmap(pages: DataFrame, docid: str, canon: Column) -> DataFrame:
    """urlfp, docid: one row for each url identity, the smallest docid."""
    return pages.select(fingerprint(canon).alias("urlfp"), F.col(docid).alias("docid")).groupBy("urlfp").agg(F.min("docid").alias("docid"))


def simhashes(docs: DataFrame, docid: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(docid).alias("docid"), simhash64(F.col(text)).alias("simhash"))


#: A hash's blocks of bits: two hashes within NEAR bits agree in all but NEAR of them. Bits of a hash go together more often the nearer they are, so a block takes every eighth.
NEAR = 3
BLOCKS = [sum(1 << at for at in range(first, 64, 8)) for first in range(8)]
#: The bits of all blocks but NEAR, by the bit set of those.
TABLES = {sum(1 << i for i in left_out): sum(b for i, b in enumerate(BLOCKS) if i not in left_out) for left_out in combinations(range(len(BLOCKS)), NEAR)}


#: Rows whose groups are compared at once.
AT_ONCE = 1 << 18


def _signed(mask: int) -> Column:
    return F.lit(mask if mask < 1 << 63 else mask - (1 << 64)).cast("bigint")


#: For each set of blocks that differ the table that leaves them out and the first others to make NEAR: the one where such a pair counts. 0 where they are too many.
TABLE_OF = np.array([next((t for t in TABLES if t & differ == differ), 0) for differ in range(1 << len(BLOCKS))])


#: Rows whose groups are compared at once.
AT_ONCE = 1 << 18


def _signed(mask: int) -> int:
    return mask if mask < 1 << 63 else mask - (1 << 64)


def pairs_of(x: np.ndarray, which: np.ndarray, ends: np.ndarray, most: int) -> pa.RecordBatch:
    """a, b, distance of the pairs that count in these tables. x: hashes, sorted in each group; ends: where the group of each ends. Each is compared with the one so many
    places behind it, all of them at once, then with the next: no row is made for a pair that is too far apart."""
    found, at, step = [], np.arange(len(x)), 0
    while len(at := at[at + (step := step + 1) < ends[at]]):
        bits = x[at] ^ x[at + step]
        near = np.flatnonzero(np.bitwise_count(bits.view(np.uint64)) <= most)
        bits, own = bits[near], at[near]
        differ = sum(((bits & _signed(b)) != 0).astype(np.int64) << i for i, b in enumerate(BLOCKS))
        once = TABLE_OF[differ] == which[own]
        found.append((x[own[once]], x[own[once] + step], np.bitwise_count(bits[once].view(np.uint64)).astype(np.int32)))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "distance"])


def ends_of(rows: np.ndarray) -> np.ndarray:
    """Of each row hash, which, bits the end of its group."""
    ends = np.append(np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(axis=0)) + 1, rows.shape[1])
    return np.repeat(ends, np.diff(np.append(0, ends)))


def near_pairs(hashes: DataFrame, most: int = NEAR) -> DataFrame:
    """a < b and distance of distinct hashes at most so far apart (up to NEAR).

    Each hash is looked up in 56 tables by 40 of its bits, and a pair counts in one of them alone, so pairs needn't be made distinct. Equal hashes are one class,
    so groups of copies are no burden; members() tells who they are. The distinct hashes are stored first: they are worked out once."""
    if not 0 <= most <= NEAR:
        raise ValueError(f"the tables find pairs up to a distance of {NEAR}")

    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [np.zeros((3, 0), np.int64)], 0
        for batch in batches:
            parts.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if (n := n + len(batch)) < at_once:
                continue
            held = np.concatenate(parts, axis=1)
            ends = ends_of(held)
            last = int(np.searchsorted(ends, len(ends)))  # where the last group begins, which may go on
            yield pairs_of(held[0, :last], held[1, :last], ends[:last], most)
            parts, n = [held[:, last:]], 0
        held = np.concatenate(parts, axis=1)
        yield pairs_of(held[0], held[1], ends_of(held), most)

    reps = saved(hashes.select("simhash").where("simhash IS NOT NULL").distinct())
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("bigint").alias("which"), F.lit(_signed(m)).cast("bigint").alias("mask")) for t, m in TABLES.items()])).alias("t")
    keyed = reps.select("simhash", tables).select("simhash", F.col("t.which").alias("which"), F.col("simhash").bitwiseAND(F.col("t.mask")).alias("bits"))
    return keyed.repartition("which", "bits").sortWithinPartitions("which", "bits", "simhash").mapInArrow(run, "a bigint, b bigint, distance int")


def members(hashes: DataFrame) -> DataFrame:
    """docid, simhash, class_id: the smallest docid with the same hash."""
    first = hashes.groupBy("simhash").agg(F.min("docid").alias("class_id"))
    return hashes.join(first, "simhash").select("docid", "simhash", "class_id")


def pagerank(edge_rows: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Extension: node, rank after so many rounds; nodes without links out give theirs to none. A plan of a few joins for each round."""
    nodes = edge_rows.select(F.col("src").alias("node")).unionAll(edge_rows.select("dst")).distinct()
    out = edge_rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    weighted = edge_rows.join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("w"))
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        flow = weighted.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        ranks = nodes.join(flow, F.col("node") == F.col("dst"), "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
    return ranks
