"""Inverted index: tokens to postings, terms, blocks, document values and their statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import MAX_POSITION, admitted, bit_length_capped, normalized, snippets
from quarry.operators.ordered import numbered
from quarry.sources.stored import saved

BODY, TITLE = 0, 1
TABLES = ("postings", "terms", "blocks", "docs", "docvalues")
#: Impact cap, postings of a block, blocks of a superblock, and the df up to which a term is inlined.
IMPACT_CAP, BLOCK, SUPERBLOCK, INLINE_DF = 255, 128, 32, 4
HEAD_DF = 4096
#: Docids of a chunk, whose postings of a term are packed, and the bits that an impact takes beside each.
CHUNK_BITS, VALUE_BITS = 14, 16
CHUNK = 1 << CHUNK_BITS
#: Bytes of files that one task's documents take, those under which no further task is worth it, and what Spark takes a table of unknown size for.
PART_BYTES, LEAST_BYTES, UNKNOWN_BYTES = 8 << 20, 1 << 19, 1 << 50
#: Ranking constants that a generation carries; searching doesn't use them.
META = {"law_ver": 1, "tokenizer_ver": 1, "quant": 1, "scale": 1.0, "k1": 1.2, "body_weight": 1.0, "body_b": 0.75, "title_weight": 2.5, "title_b": 0.6}


def by_docid(rows: DataFrame, docid: str = "docid") -> DataFrame:
    """rows dealt out by ranges of docid, about PART_BYTES of their files each: all that is counted in a document stays in a task, whose counts fit its memory."""
    leaves, spark = rows._jdf.queryExecution().optimizedPlan().collectLeaves(), rows.sparkSession
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes) >= UNKNOWN_BYTES:  # rows that aren't of files
        return rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), docid)
    return rows.repartitionByRange(max(-(-sum(sizes) // PART_BYTES), min(spark.sparkContext.defaultParallelism, -(-sum(sizes) // LEAST_BYTES)), 1), docid)


def tokens(docs: DataFrame, docid: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """docid, field, pos, term of the admitted tokens of both fields, in ranges of docid: texts are shuffled, tokens needn't be.

    Texts come in NFKC before that, as Spark forgets behind Python how rows are dealt out."""
    rows = normalized(docs.select(F.col(docid).alias("docid"), F.col(text).alias("body"), *([F.col(title).alias("title")] if title else [])), "body")
    rows = by_docid(normalized(rows, "title") if title else rows)
    body = admitted(rows, ["docid"], "body", True).withColumn("field", F.lit(BODY))
    if title is None:
        return body
    return body.unionByName(admitted(rows, ["docid"], "title", True).withColumn("field", F.lit(TITLE)))


def postings(toks: DataFrame, with_positions: bool = False) -> DataFrame:
    """term, docid, tf (both fields), impact, mask (a bit for each field), and if asked body_n and the positions in each field, strictly increasing: all beyond the last that fits collapse into one.

    With positions the rows of a partition come sorted by term and docid."""
    if with_positions:
        place = F.row_number().over(Window.partitionBy("term", "docid").orderBy("field", "pos"))
        rows = toks.select("term", "docid", "field", "pos", place.alias("n"))
        docid = dict(rows.dtypes)["docid"]
        rows = rows.mapInArrow(gathered, f"term string, docid {docid}, tf int, mask int, body_n int, body_pos array<int>, title_pos array<int>")
    else:
        rows = toks.groupBy("term", "docid").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.bit_or(F.expr("shiftleft(1, field)")).alias("mask"))
    return rows.withColumn("impact", F.least("tf", F.lit(IMPACT_CAP)))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group of rows term, docid, field, pos, n that begins with n = 1, in the order they come in. The last group of a batch waits for the next."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        starts = np.flatnonzero(rows["n"].to_numpy() == 1)
        if len(starts) > 1:
            yield groups(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1]) if len(starts) else rows
    if held is not None and len(held):
        yield groups(held, np.zeros(1, np.int64))


def groups(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Row i is of the rows from starts[i] up to the next start."""
    field, pos = rows["field"].to_numpy(), np.minimum(rows["pos"].to_numpy(), MAX_POSITION)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    fresh = np.append(True, (group[1:] != group[:-1]) | (field[1:] != field[:-1]) | (pos[1:] != pos[:-1]))
    number = lambda which: np.bincount(group[which], minlength=len(starts)).astype(np.int32)

    def lists(which: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(number(which))).astype(np.int32), pa.array(pos[which], pa.int32()))

    of = lambda c: rows[c].combine_chunks().take(pa.array(starts))
    columns = {
        "term": of("term"), "docid": of("docid"), "tf": number(slice(None)), "mask": np.bitwise_or.reduceat(1 << field.astype(np.int32), starts).astype(np.int32),
        "body_n": number(field == BODY), "body_pos": lists(fresh & (field == BODY)), "title_pos": lists(fresh & (field == TITLE)),
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def terms(posts: DataFrame) -> DataFrame:
    """df, cf (sum of uncapped tf), bound (highest impact) of each term, and whether it is inlined."""
    got = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("bigint")).alias("cf"), F.max("impact").alias("bound"))
    return got.withColumn("inlined", F.col("df") <= INLINE_DF)


def head_terms(term_table: DataFrame, min_df: int = HEAD_DF) -> DataFrame:
    return term_table.where((F.col("df") >= min_df) & ~F.col("inlined"))


def head_budget(term_table: DataFrame, min_df: int, budget: int, bytes_each: int = 8) -> DataFrame:
    """The head terms, highest df first, up to the first that doesn't fit the budget of block bytes."""
    heads = head_terms(term_table, min_df).withColumn("bytes", F.ceil(F.col("df") / BLOCK) * bytes_each)
    return numbered(heads, [F.desc("df"), F.col("term")], "_place", ("bytes", "running")).drop("_place").where(F.col("running") <= budget)


def packs(posts: DataFrame, value: str | None = None) -> DataFrame:
    """term, chunk, own (the sorted docids of the term in a chunk of CHUNK docids, from its begin, each with the value below it in VALUE_BITS), before (the term's postings in
    earlier chunks), last (their last docid), df. Stored.

    Postings travel packed, a row for each term and chunk, never more than CHUNK in one; a window counts the packs of a term, not its postings. A posting without a docid is in none."""
    code = F.shiftleft(F.col("docid") - F.col("chunk") * CHUNK, VALUE_BITS).bitwiseOR(F.col(value) if value else F.lit(0)).cast("int")
    rows = posts.withColumn("chunk", F.shiftright("docid", CHUNK_BITS)).select("term", "chunk", code.alias("code"))
    own = saved(rows.groupBy("term", "chunk").agg(F.sort_array(F.collect_list("code")).alias("own")))
    order = Window.partitionBy("term").orderBy("chunk")
    n, last = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lag("_last").over(order)
    light = own.select("term", "chunk", F.size("own").alias("_n"), (F.col("chunk") * CHUNK + F.shiftright(F.element_at("own", -1), VALUE_BITS)).alias("_last"))
    places = light.select("term", "chunk", F.coalesce(n, F.lit(0)).alias("before"), F.coalesce(last, F.lit(0)).alias("last"), F.sum("_n").over(Window.partitionBy("term")).alias("df"))
    return own.join(places, ["term", "chunk"])


def numbered_blocks(posts: DataFrame) -> DataFrame:
    """term, docid, impact and the block of each posting; inlined terms have none."""
    rows = packs(posts, "impact").where(F.col("df") > INLINE_DF).select("term", "chunk", "before", F.posexplode("own").alias("_i", "_code"))
    return rows.select(
        "term", (F.col("chunk") * CHUNK + F.shiftright("_code", VALUE_BITS)).alias("docid"), F.col("_code").bitwiseAND(F.lit((1 << VALUE_BITS) - 1)).alias("impact"),
        F.floor((F.col("before") + F.col("_i")) / BLOCK).alias("block_id"),
    )


def blocks(posts: DataFrame) -> DataFrame:
    rows = numbered_blocks(posts).groupBy("term", "block_id")
    return rows.agg(F.min("docid").alias("first_docid"), F.max("docid").alias("last_docid"), F.count(F.lit(1)).alias("n"), F.max("impact").alias("max_impact"))


def superblocks(block_table: DataFrame) -> DataFrame:
    """Derived from the blocks alone."""
    rows = block_table.withColumn("l2_id", F.floor(F.col("block_id") / SUPERBLOCK)).groupBy("term", "l2_id")
    return rows.agg(F.max("last_docid").alias("last_docid"), F.max("max_impact").alias("max_impact"), F.count(F.lit(1)).alias("blocks"))


def gaps(posts: DataFrame) -> DataFrame:
    """Distance of each docid from the one before it in its term (of the first, from 0). A pack's first looks at the last of the pack before."""
    docid = lambda code: F.col("chunk") * CHUNK + F.shiftright(code, VALUE_BITS)
    rows = packs(posts).select("term", "chunk", "last", F.explode(F.arrays_zip(F.col("own").alias("to"), F.concat(F.array(F.lit(None).cast("int")), F.slice("own", 1, F.size("own") - 1)).alias("since"))).alias("_at"))
    return rows.select("term", docid(F.col("_at.to")).alias("docid"), (docid(F.col("_at.to")) - F.coalesce(docid(F.col("_at.since")), F.col("last"))).alias("gap"))


def lengths(posts: DataFrame) -> DataFrame:
    """docid, body, title: the admitted tokens of each field, from postings with field counts."""
    return posts.groupBy("docid").agg(F.sum("body_n").alias("body"), F.sum(F.col("tf") - F.col("body_n")).alias("title"))


def doc_values(docs: DataFrame, toks: DataFrame, docid: str = "doc_id") -> DataFrame:
    """docid, quality, spam, doclen_body, doclen_title: only admitted tokens count, as bit lengths."""
    counts = toks.groupBy("docid").agg(F.count_if(F.col("field") == BODY).alias("body"), F.count_if(F.col("field") == TITLE).alias("title"))
    return values_of(docs, counts, docid)


def values_of(docs: DataFrame, counts: DataFrame, docid: str = "doc_id") -> DataFrame:
    """doc_values() from docid, body, title."""
    rows = docs.select(F.col(docid).alias("docid")).join(counts, "docid", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("docid", F.lit(128).alias("quality"), F.lit(0).alias("spam"), bit_length_capped(n("body"), 255).alias("doclen_body"), bit_length_capped(n("title"), 15).alias("doclen_title"))


def field_stats(docs: DataFrame, toks: DataFrame) -> DataFrame:
    """field, sum_len, doc_count, avg_len (0 without documents)."""
    n = docs.agg(F.count(F.lit(1)).alias("doc_count"))
    got = toks.groupBy("field").agg(F.count(F.lit(1)).alias("sum_len")).crossJoin(F.broadcast(n))  # one row
    return got.withColumn("avg_len", F.when(F.col("doc_count") > 0, F.col("sum_len") / F.col("doc_count")).otherwise(0.0))


def write_index(docs: DataFrame, path: str, shard: int = 0, generation: int = 1, docid: str = "doc_id", title: str | None = None, url: str | None = None, tables: Sequence[str] = TABLES) -> None:
    """Writes one generation of one shard: postings, terms, blocks, docs and docvalues, or some of them; those after the postings are made of them. Texts are tokenized once. Nothing to index is an error.

    Each file of postings is that of a range of documents, sorted by term, so the pages of a term are found in each and no posting is shuffled."""
    at = lambda table: f"{path}/{table}/shard={shard}/generation={generation}"
    spark = docs.sparkSession
    if "postings" in tables:
        postings(tokens(docs, docid, "text", title), True).write.mode("overwrite").parquet(at("postings"))
    posts = spark.read.parquet(at("postings"))
    if "postings" in tables and not posts.limit(1).count():
        raise ValueError("no postings")
    if "terms" in tables:
        terms(posts).sortWithinPartitions("term").write.mode("overwrite").parquet(at("terms"))
    if "blocks" in tables:
        blocks(posts.select("term", "docid", "impact")).sortWithinPartitions("term", "block_id").write.mode("overwrite").parquet(at("blocks"))
    if "docs" in tables:
        shown = docs.select(F.col(docid).alias("docid"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"), (F.col(title) if title else F.lit("")).alias("title"), snippets(F.col("text")).alias("snippet"))
        shown.sortWithinPartitions("docid").write.mode("overwrite").parquet(at("docs"))
    if "docvalues" in tables:
        values_of(docs, lengths(posts), docid).write.mode("overwrite").parquet(at("docvalues"))


def load(spark, path: str, table: str, generation: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{table}")
    return df if generation is None else df.where(F.col("generation") == generation)
