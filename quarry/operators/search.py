"""Ranked retrieval: additive scores over a union of terms, top candidates of each shard, top k of all."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import global_docid
from quarry.functions.text import snippets
from quarry.operators.index import IMPACT_CAP
from quarry.sources.stored import saved

#: Limits of a query, and the score's largest value.
MAX_SHARDS, MAX_TERMS, MAX_TERM_BYTES, SCORE_CAP = 1024, 32, 64, 65535
MAX_ENTRIES, MAX_SNIPPETS = 4096, 1024
SPAM_LIMIT = 128
SHOULD, MUST, NOT = 0, 1, 2
#: What a result lacks: terms, k, blocks, a replica, a shard.
DEGRADE_TERMS, DEGRADE_K, DEGRADE_BLOCKS, DEGRADE_REPLICA, DEGRADE_SHARD = 1, 2, 4, 8, 16


def validate(terms: list[str | tuple[str, int]], k: int, candidates: int, shards: list[int]) -> None:
    pairs = [t if isinstance(t, tuple) else (t, SHOULD) for t in terms]
    if k < 1 or candidates < k or k > MAX_ENTRIES:
        raise ValueError("1 <= k <= candidates and k <= 4096 are asked for")
    if not 1 <= len(shards) <= MAX_SHARDS or not 1 <= len(pairs) <= MAX_TERMS:
        raise ValueError("1 to 1024 shards and 1 to 32 terms are asked for")
    if any(not 1 <= len(t.encode()) <= MAX_TERM_BYTES or op not in (SHOULD, MUST, NOT) for t, op in pairs):
        raise ValueError("a term has 1 to 64 bytes and an operator from 0 to 2")


def query_rows(spark: SparkSession, queries: dict[int, Iterable[str | tuple[str, int]]]) -> DataFrame:
    """query_id, term, op, times: a repeated term counts each time. Each query is validated."""
    queries = {q: list(terms) for q, terms in queries.items()}
    for terms in queries.values():
        validate(terms, 1, 1, [0])
    rows = [(q, *(t if isinstance(t, tuple) else (t, SHOULD))) for q, terms in queries.items() for t in terms]
    return spark.createDataFrame(rows, "query_id bigint, term string, op int").groupBy("query_id", "term", "op").agg(F.count(F.lit(1)).cast("int").alias("times"))


def top(df: DataFrame, partition: list[str], k: int, order: list) -> DataFrame:
    """Rows of rank k or better in each partition, with the rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= k)


def scores(postings: DataFrame, queries: DataFrame, deleted: DataFrame | None = None, enforce_ops: bool = False) -> DataFrame:
    """query_id, shard, docid, score > 0. postings: term, docid, tf and maybe shard.

    By default NOT terms are skipped and MUST ones are like the others, as the service does; with enforce_ops MUST terms have to be there and NOT terms not. deleted: shard and docid that no result may hold."""
    posts = postings if "shard" in postings.columns else postings.withColumn("shard", F.lit(0))
    hits = posts.join(queries, "term")
    keys = ["query_id", "shard", "docid"]
    if not enforce_ops:
        hits = hits.where(F.col("op") != NOT)
    score = F.sum(F.when(F.col("op") != NOT, F.least("tf", F.lit(IMPACT_CAP)).cast("bigint") * F.col("times")).otherwise(0)).alias("score")
    out = hits.groupBy(*keys).agg(score, F.count_if(F.col("op") == MUST).alias("_must"), F.count_if(F.col("op") == NOT).alias("_not"))
    if enforce_ops:
        need = queries.groupBy("query_id").agg(F.count_if(F.col("op") == MUST).alias("_need"))
        out = out.join(need, "query_id").where((F.col("_must") == F.col("_need")) & (F.col("_not") == 0))
    if deleted is not None:
        out = out.join(deleted if "shard" in deleted.columns else deleted.withColumn("shard", F.lit(0)), ["shard", "docid"], "left_anti")
    return out.where("score > 0").select(*keys, "score")


def search(postings: DataFrame, queries: DataFrame, k: int, candidates: int | None = None, shards: list[int] | None = None, deleted: DataFrame | None = None, enforce_ops: bool = False) -> DataFrame:
    """query_id, rank, docid (shard in its upper half), score: each shard's best candidates, scores capped, then the best k; ties by shard order, then docid."""
    candidates = candidates or k
    _valid(k, candidates, shards)
    return best_of(scores(postings, queries, deleted, enforce_ops), k, candidates, shards)


def _valid(k: int, candidates: int, shards: list[int] | None = None) -> None:
    if not 1 <= k <= min(candidates, MAX_ENTRIES) or shards is not None and not 1 <= len(shards) <= MAX_SHARDS:
        raise ValueError("1 <= k <= candidates, k <= 4096 and 1 to 1024 shards are asked for")


def best_of(found: DataFrame, k: int, candidates: int, shards: list[int] | None = None) -> DataFrame:
    """The best candidates of each shard, and of those the best k."""
    if shards is not None:
        place = F.array_position(F.array(*[F.lit(s) for s in shards]), F.col("shard").cast("int"))
        found = found.where(F.col("shard").isin(shards)).withColumn("_place", place)
    else:
        found = found.withColumn("_place", F.col("shard"))
    best = top(found, ["query_id", "shard"], candidates, [F.desc("score"), "docid"]).drop("rank")
    best = best.withColumn("score", F.least("score", F.lit(SCORE_CAP)))
    out = top(best, ["query_id"], k, [F.desc("score"), "_place", "docid"])
    return out.select("query_id", "rank", global_docid(F.col("shard"), F.col("docid")).alias("docid"), "score")


#: Documents and queries whose scores are worked out at once.
DOCS_AT_ONCE, QUERIES_AT_ONCE = 1024, 256


def search_batch(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As search() on one shard, for a batch of queries that share many terms: the postings of all their terms are dealt out by document, and a task's scores are a product of
    two matrices, documents by terms and terms by queries. Each task sends the best k of each query, so no row is made for each query and document.

    The batch (a row for each query and term) is held by the driver and each task."""
    _valid(k, k)
    rows = queries.where(F.col("op") != NOT).groupBy("query_id", "term").agg(F.sum("times").alias("times")).collect()
    ids, terms = sorted({r.query_id for r in rows}), sorted({r.term for r in rows})
    at, number = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    asked_by = np.array([(at[r.query_id], number[r.term], r.times) for r in rows], np.int64).reshape(-1, 3)
    # A float holds whole numbers below 2 ** 24.
    kind = np.float32 if IMPACT_CAP * np.bincount(asked_by[:, 0], asked_by[:, 2]).max(initial=0) < 1 << 24 else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for a in range(0, len(ids), QUERIES_AT_ONCE):
            own = asked_by[(asked_by[:, 0] >= a) & (asked_by[:, 0] < a + QUERIES_AT_ONCE)]
            used, place = np.unique(own[:, 1], return_inverse=True)
            weights = np.zeros((len(used), min(QUERIES_AT_ONCE, len(ids) - a)), kind)
            weights[place, own[:, 0] - a] = own[:, 2]
            parts.append((a, used, weights))
        best, floor = [np.zeros((3, 0), np.int64)], np.zeros(len(ids), np.int64)  # query, docid, score; what a later document has to exceed
        for docids, at, term, impact in documents(batches):
            held = np.zeros((len(docids), len(terms)), kind)
            np.add.at(held, (at, term), impact)
            for a, used, weights in parts:
                score = held[:, used] @ weights
                doc, query = np.nonzero(score > floor[a : a + weights.shape[1]])
                best.append(np.stack([query + a, docids[doc], score[doc, query].astype(np.int64)]))
            if sum(x.shape[1] for x in best) > max(2 * k * len(ids), 1 << 18):
                best = [kept_best(np.concatenate(best, axis=1), k, floor)]
        found = kept_best(np.concatenate(best, axis=1), k, floor)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "docid", "score"])

    spark = queries.sparkSession
    numbers = spark.createDataFrame([(t, i) for t, i in number.items()], "term string, number int")
    posts = postings.join(F.broadcast(numbers), "term").select("docid", "number", F.least("tf", F.lit(IMPACT_CAP)).cast("int").alias("impact"))
    found = posts.repartition("docid").sortWithinPartitions("docid").mapInArrow(run, "query_id bigint, docid bigint, score bigint")
    return best_of(found.withColumn("shard", F.lit(0)), k, k)


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows docid, number, impact, sorted by docid, by up to DOCS_AT_ONCE whole documents: their docids, and of each row the place of its docid there, number and impact."""
    held = np.zeros((3, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        docids, starts = np.unique(held[0], return_index=True)
        whole = len(docids) - 1  # the last may go on
        for a in range(0, whole - whole % DOCS_AT_ONCE, DOCS_AT_ONCE):
            yield _part(held[:, starts[a] : starts[a + DOCS_AT_ONCE]])
        held = held[:, starts[whole - whole % DOCS_AT_ONCE] :] if whole >= 0 else held
    docids, starts = np.unique(held[0], return_index=True)
    for a in range(0, len(docids), DOCS_AT_ONCE):
        yield _part(held[:, starts[a] : starts[a + DOCS_AT_ONCE] if a + DOCS_AT_ONCE < len(docids) else None])


def _part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docids, at = np.unique(rows[0], return_inverse=True)
    return docids, at, rows[1], rows[2]


def kept_best(rows: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """Of rows query, docid, score the best k of each query, the smaller docid first; floor gets the score of the k-th where there is one."""
    rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
    begins = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])) if rows.shape[1] else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, rows.shape[1]))
    rank = np.arange(rows.shape[1]) - np.repeat(begins, sizes)
    full = begins[sizes >= k]
    floor[rows[0][full]] = rows[2][full + k - 1]
    return rows[:, rank < k]


def degrade_bits(spark: SparkSession, asked: list[int], mounted: list[int]) -> int:
    """A shard that was asked for and isn't mounted sets its bit."""
    return DEGRADE_SHARD if set(asked) - set(mounted) else 0


def dev_search(postings: DataFrame, queries: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """Exhaustive scores cut at k, and only then without spam: it may return fewer."""
    best = search(postings, queries, k)
    return values.select("docid", "spam").join(F.broadcast(best), "docid").where(F.col("spam") <= SPAM_LIMIT).select("query_id", "rank", "docid", "score")


def displayed(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with what is shown of them, in their order; records are only looked up for the final page, which goes to where they are."""
    return docs.join(F.broadcast(hits), "docid").select("query_id", "rank", "docid", "score", *[c for c in docs.columns if c != "docid"])


def with_snippets(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with the snippet of each; docs: docid, text. The snippet is found for the hits alone, which go to where the texts are: no text is shuffled."""
    return docs.select("docid", "text").join(F.broadcast(hits), "docid").select("query_id", "rank", "docid", "score", snippets(F.col("text")).alias("snippet"))


def asked(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, term, docid, s of every posting of the queries' terms that counts: one scan of the postings, stored."""
    posts = postings.select("term", "docid", F.least("tf", F.lit(IMPACT_CAP)).cast("bigint").alias("impact"))
    return saved(posts.join(queries.where(F.col("op") != NOT).select("query_id", "term", "times"), "term").select("query_id", "term", "docid", (F.col("impact") * F.col("times")).alias("s")))


def threshold(rows: DataFrame, k: int) -> DataFrame:
    """query_id, floor: a score that the k-th best document reaches for sure, that of the k-th best under one term; 1 where no term has k documents."""
    best = top(rows, ["query_id", "term"], k, [F.desc("s"), "docid"]).groupBy("query_id", "term").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(1).alias("floor"))
    return best.groupBy("query_id").agg(F.max("floor").alias("floor"))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    got = rows.groupBy("query_id", "docid").agg(F.sum("s").alias("score")).where("score > 0")
    return top(got, ["query_id"], k, [F.desc("score"), "docid"]).select("query_id", "rank", "docid", F.least("score", F.lit(SCORE_CAP)).alias("score"))


def without(postings: DataFrame, deleted: DataFrame | None) -> DataFrame:
    return postings if deleted is None else postings.join(deleted, "docid", "left_anti")


def pruned_search(postings: DataFrame, blocks: DataFrame, queries: DataFrame, k: int, span: int = 4096, deleted: DataFrame | None = None) -> DataFrame:
    """As search() on one shard, after block-max pruning: only docid ranges of which the blocks' largest impacts together reach the threshold are scored.

    Terms without blocks (inlined) count with their few postings themselves."""
    rows = asked(without(postings, deleted), queries)
    known = queries.where(F.col("op") != NOT).select("query_id", "term", "times")
    in_blocks = known.join(blocks.select("term", "first_docid", "last_docid", "max_impact"), "term")
    cells = in_blocks.select("query_id", "term", F.explode(F.sequence(F.floor(F.col("first_docid") / span), F.floor(F.col("last_docid") / span))).alias("cell"), (F.col("max_impact") * F.col("times")).alias("s"))
    few = rows.join(blocks.select("term").distinct(), "term", "left_anti").select("query_id", "term", F.floor(F.col("docid") / span).alias("cell"), "s")
    most = cells.unionAll(few).groupBy("query_id", "cell", "term").agg(F.max("s").alias("s")).groupBy("query_id", "cell").agg(F.sum("s").alias("most"))
    wanted = most.join(threshold(rows, k), "query_id").where("most >= floor").select("query_id", "cell")
    return ranked(rows.withColumn("cell", F.floor(F.col("docid") / span)).join(wanted, ["query_id", "cell"], "left_semi"), k)


def reach(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term, most (what the term can add to a score) and reach: what it and the query's weaker terms can add together."""
    known = queries.where(F.col("op") != NOT).join(terms.select("term", "df", "bound"), "term").withColumn("most", (F.col("bound") * F.col("times")).cast("bigint"))
    order = Window.partitionBy("query_id").orderBy("most", "df", "term").rowsBetween(Window.unboundedPreceding, 0)  # a query has few terms
    return known.withColumn("reach", F.sum("most").over(order))


def maxscore_search(postings: DataFrame, terms: DataFrame, queries: DataFrame, k: int, deleted: DataFrame | None = None) -> DataFrame:
    """As search() on one shard, by MaxScore: documents that hold only terms whose reach is below the threshold are no candidates; those terms are looked up for the candidates alone."""
    rows = asked(without(postings, deleted), queries)
    known = reach(queries, terms).join(threshold(rows, k), "query_id")
    essential = known.where("reach >= floor").select("query_id", "term")
    candidates = rows.join(F.broadcast(essential), ["query_id", "term"], "left_semi").select("query_id", "docid").distinct()
    return ranked(rows.join(candidates, ["query_id", "docid"], "left_semi"), k)


def hybrid_search(postings: DataFrame, terms: DataFrame, blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries of up to two different terms by block-max, the others by MaxScore."""
    few = queries.where(F.col("op") != NOT).groupBy("query_id").agg(F.countDistinct("term").alias("n")).where("n <= 2").select("query_id")
    short, long = queries.join(few, "query_id", "left_semi"), queries.join(few, "query_id", "left_anti")
    return pruned_search(postings, blocks, short, k).unionByName(maxscore_search(postings, terms, long, k))


def traverse_stats(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, postings, docs, best: what a traversal of all postings of each query's terms scores."""
    rows = asked(postings, queries).groupBy("query_id", "docid").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("score"))
    return rows.groupBy("query_id").agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("docs"), F.max("score").alias("best"))


def records_in_order(docs: DataFrame, docids: list[int]) -> DataFrame:
    """pos and the records of the docids asked for, in their order (sort by pos); unknown ones are missing. More than MAX_SNIPPETS are an error."""
    if len(docids) > MAX_SNIPPETS:
        raise ValueError(f"more than {MAX_SNIPPETS} records asked for")
    wanted = docs.sparkSession.createDataFrame(list(enumerate(docids)), "pos int, docid bigint")
    return docs.join(F.broadcast(wanted), "docid").select("pos", *docs.columns)
