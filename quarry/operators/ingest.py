"""Corpus import: URL laws, fingerprints, host partitions, exact dedup, segments and their commits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.hashing import fingerprint, rfc3339_ms, simhash64
from quarry.functions.url import canonicalize_url, host_partition
from quarry.operators.ordered import numbered
from quarry.schemas import URL_LAW_VERSION
from quarry.sources.stored import saved

#: Bytes that a text needs, rows and bytes at which a segment is sealed, and what each row counts besides text and URL.
MIN_TEXT, SEGMENT_ROWS, SEGMENT_BYTES, ROW_BYTES = 64, 16384, 64 << 20, 80
FLAG_IMPORTED = 1


def outcomes(records: DataFrame) -> DataFrame:
    """records (url, text, date order key `arrival`) with canon and outcome: short, rejected or kept. Only texts that are long enough reach the URL laws."""
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < MIN_TEXT
    rows = records.withColumn("canon", canonicalize_url(F.when(~short, F.col("url"))))
    return rows.withColumn("outcome", F.when(short, "short").when(F.col("canon").isNull(), "rejected").otherwise("kept"))


def hashed(rows: DataFrame, parts: int) -> DataFrame:
    """Adds urlfp and sha (hex) and the partition of the host."""
    return rows.withColumns({"urlfp": fingerprint(F.col("canon")), "sha": F.sha2("text", 256), "partition": host_partition(F.col("canon"), parts)})


def first_wins(rows: DataFrame, keys: list[str], arrival: str | list[str] = "arrival") -> DataFrame:
    """rows with dup: whether an earlier row of the same keys is there; nulls are a key like any other. arrival: the columns that order all rows.

    The first is found map-side, so large groups of copies are no burden."""
    order = F.struct(*([arrival] if isinstance(arrival, str) else arrival))
    first = rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("_first"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return rows.join(first, same).withColumn("dup", order > F.col("_first")).drop("_first", *[f"_key{i}" for i in range(len(keys))])


def firsts(rows: DataFrame, keys: list[str], arrival: str | list[str] = "arrival") -> DataFrame:
    """The rows that first_wins() doesn't mark, in one pass: each task sends one row of a key at most."""
    order = [arrival] if isinstance(arrival, str) else arrival
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def copies(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """keys, their first row and how many there are."""
    return rows.groupBy(*keys).agg(F.min(arrival).alias(arrival), F.count(F.lit(1)).alias("copies"))


def segment_numbers(rows: DataFrame, arrival: str = "arrival", limit: int = SEGMENT_ROWS) -> DataFrame:
    """seq of each row's segment in its partition, from 1, if segments are sealed by rows alone."""
    order = Window.partitionBy("partition").orderBy(arrival)
    return rows.withColumn("seq", F.floor((F.row_number().over(order) - 1) / limit) + 1)


def sealed_by_size(rows: DataFrame, arrival: str | list[str] = "arrival", max_rows: int = SEGMENT_ROWS, max_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """rows with seq, the segment of each in its partition: a segment is sealed after the row that reaches max_rows or max_bytes.

    segments() sees the sizes alone; rows are stored, and each gets its number back where it is. Rows of one place count in the order of their sizes."""
    order = [arrival] if isinstance(arrival, str) else arrival
    tie = lambda df: df.withColumn("_key", F.struct("partition", *order)).withColumn("_tie", F.row_number().over(Window.partitionBy("_key").orderBy("_size")))
    sized = saved(rows.withColumn("_size", size_of()))
    seqs = tie(segments(sized, order, max_rows, max_bytes)).select("_key", "_tie", "seq")
    return tie(sized).join(seqs, ["_key", "_tie"]).select(*rows.columns, "seq")


def size_of() -> Column:
    """The bytes that a row counts."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + ROW_BYTES).cast("long")


def segments(sizes: DataFrame, order: list[str], max_rows: int = SEGMENT_ROWS, max_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """partition, the columns of order, _size and seq, sealed_by_size()'s, of rows with _size.

    A running sum that starts again has no built-in form; one pass over each partition's places and sizes, sorted by Spark, a batch at a time. No text comes here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, n, total = None, 1, 0, 0
        for batch in batches:
            out = []
            for p, size in zip(batch.column("partition").to_pylist(), batch.column("_size").to_pylist(), strict=True):
                if p != part:
                    part, seq, n, total = p, 1, 0, 0
                out.append(seq)
                n, total = n + 1, total + size
                if n >= max_rows or total >= max_bytes:
                    seq, n, total = seq + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "seq"])

    sized = sizes.select("partition", *order, "_size").repartition("partition").sortWithinPartitions("partition", *order, "_size")
    return sized.mapInArrow(run, T.StructType([*sized.schema.fields, T.StructField("seq", T.LongType())]))


def page_rows(kept: DataFrame, fetch_ms: Column, *more: str) -> DataFrame:
    """The rows as pages, with more of their columns; title, links and language stay empty."""
    return kept.select(
        "partition", F.unhex("urlfp").alias("urlfp"), F.col("canon").alias("url"), fetch_ms.alias("fetch_ms"), F.lit(200).alias("status"), F.lit(FLAG_IMPORTED).cast("bigint").alias("flags"),
        F.unhex("sha").alias("sha256"), simhash64(F.col("text")).alias("simhash"), F.lit(0).alias("lang"), F.lit(None).cast("binary").alias("canon_fp"), F.lit(None).cast("binary").alias("hdr"),
        F.lit("").alias("title"), "text", F.expr("CAST(array() AS ARRAY<STRUCT<dst: BINARY, flags: INT, anchor: STRING>>)").alias("outlinks"),
        F.expr("CAST(NULL AS STRUCT<seq: BIGINT, off: BIGINT, len: BIGINT>)").alias("raw_ref"), F.lit(URL_LAW_VERSION).alias("law_ver"), *more,
    )


def statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pages, dups, rejected, short of rows with outcome: copies are counted by their keys, in one pass."""
    groups = rows.groupBy("outcome", *[F.when(F.col("outcome") == "kept", F.col(k)).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    of = lambda outcome, value: F.coalesce(F.sum(F.when(F.col("outcome") == outcome, value)), F.lit(0)).cast("bigint")
    return groups.agg(of("kept", F.lit(1)).alias("pages"), of("kept", F.col("n") - 1).alias("dups"), of("rejected", F.col("n")).alias("rejected"), of("short", F.col("n")).alias("short"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages by partition, by fetch time inside each file; a bloom filter on urlfp serves point lookups."""
    out = pages.repartition("partition").sortWithinPartitions("partition", "fetch_ms").write.mode("append").partitionBy("partition")
    out.option("compression", "zstd").option("parquet.bloom.filter.enabled#urlfp", "true").option("parquet.bloom.filter.expected.ndv#urlfp", "1000000").parquet(path)


def commit(spark: SparkSession, pages: DataFrame, path: str, log_path: str, epoch: int, writer: int, seq: int) -> None:
    """Two steps: the rows, then the log event that makes them visible."""
    write_pages(pages.withColumn("seg_seq", F.lit(seq).cast("bigint")), path)
    got = spark.read.parquet(path).where(F.col("seg_seq") == seq)
    event = got.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.max("fetch_ms").alias("watermark"))
    event.select(F.lit("seg_commit").alias("kind"), F.lit(epoch).alias("epoch"), F.lit(writer).alias("writer"), "partition", F.lit(seq).cast("bigint").alias("seg_seq"), "rows", "watermark").write.mode("append").parquet(log_path)


def visible(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose segment has a commit event."""
    return pages.join(log.where("kind = 'seg_commit'").select("partition", "seg_seq"), ["partition", "seg_seq"], "left_semi")


#: What tells pages apart, and the order of records: the file, then the place in it.
PAGE_KEYS, ARRIVAL = ["partition", "urlfp", "sha"], ["file", "arrival"]


def import_records(records: DataFrame, parts: int = 16, max_rows: int = SEGMENT_ROWS, max_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """WARC records (file, arrival, type, url, date, text) of any number of files as pages, each with the segment (seq) of its partition.

    Files come in order of their names. Of equal pages the first record's stays; a record with a null text or URL is short or rejected."""
    rows = outcomes(records.where("type = 'conversion'")).where("outcome = 'kept'")
    sealed = sealed_by_size(firsts(hashed(rows, parts), PAGE_KEYS, ARRIVAL), ARRIVAL, max_rows, max_bytes)
    return page_rows(sealed, rfc3339_ms(F.col("date")), "seq", *ARRIVAL)


def import_statistics(records: DataFrame, parts: int = 16, max_rows: int = SEGMENT_ROWS, max_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """pages, dups, rejected, short and segments of an import."""
    rows = saved(hashed(outcomes(records.where("type = 'conversion'")), parts).select("outcome", *PAGE_KEYS, *ARRIVAL, size_of().alias("_size")))  # counted and sealed without the texts
    sealed = segments(firsts(rows.where("outcome = 'kept'"), PAGE_KEYS, ARRIVAL), ARRIVAL, max_rows, max_bytes)
    n = sealed.groupBy("partition").agg(F.max("seq").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("segments"))
    return statistics(rows, PAGE_KEYS).crossJoin(F.broadcast(n))  # one row each


def docids(pages: DataFrame, order: list[str] | None = None) -> DataFrame:
    """pages with docid: their place by partition, segment and arrival, from 0."""
    return numbered(pages, order or ["partition", "seq", *ARRIVAL], "docid")
