"""Sinks and readers of the crawl's own tables: docmap, link graph, raw HTML, manifests, tombstone pages, frontier sections and fetch ledger, checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import fold
from quarry.schemas import DOCMAP, GC_TOMBSTONE, LEDGER, checked

#: Largest raw segment in bytes, and sections of a frontier checkpoint.
RAW_BYTES, MAX_SECTIONS = 4 << 30, 64


def write_docmap(rows: DataFrame, path: str) -> None:
    """urlfp, docid, canon_fp, flags: one row for each url identity, the smallest docid's, in ranges of urlfp, sorted, so a lookup reads few row groups."""
    one = rows.groupBy("urlfp").agg(F.min(F.struct("docid", "canon_fp", "flags")).alias("v")).select("urlfp", "v.*")
    checked(one, DOCMAP).repartitionByRange("urlfp").sortWithinPartitions("urlfp").write.option("parquet.bloom.filter.enabled#urlfp", "true").parquet(path)


def find(docmap: DataFrame, fingerprints: list[bytes]) -> DataFrame:
    """Rows of the fingerprints asked for; the filter reaches the scan and its bloom filters."""
    return docmap.where(F.col("urlfp").isin([F.lit(bytearray(f)) for f in fingerprints]))


def merged_docmap(generations: list[DataFrame]) -> DataFrame:
    """The docmap over several generations, the newest last: of an identity the newest row counts."""
    marked = [g.withColumn("_age", F.lit(i)) for i, g in enumerate(generations)]
    rows = reduce(DataFrame.unionByName, marked)
    return rows.groupBy("urlfp").agg(F.max(F.struct("_age", "docid", "canon_fp", "flags")).alias("v")).select("urlfp", "v.docid", "v.canon_fp", "v.flags")


def write_graph(edges: DataFrame, path: str) -> None:
    """Distinct edges (src, dst), sorted: a source's are next to each other, however many, and files hold ranges of sources."""
    edges.select("src", "dst").distinct().repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.parquet(path)


def write_raw(pages: DataFrame, path: str) -> None:
    """docid, html and its length, in order of docids; a page beyond the cap is an error."""
    rows = pages.select("docid", "html", F.octet_length("html").cast("long").alias("len"))
    sound = rows.withColumn("html", F.when(F.col("len") > RAW_BYTES, F.raise_error("a page of more than 4 GiB")).otherwise(F.col("html")))
    sound.repartitionByRange("docid").sortWithinPartitions("docid").write.option("compression", "zstd").parquet(path)


def write_manifest(segments: DataFrame, path: str, version: int) -> None:
    """A complete listing (partition, seg_seq, rows, watermark) that supersedes those of lower versions. A version is written once."""
    segments.select("partition", "seg_seq", "rows", "watermark").withColumn("version", F.lit(version).cast("bigint")).write.partitionBy("version").mode("append").parquet(_new(segments.sparkSession, path, "version", version))


def _new(spark: SparkSession, path: str, column: str, value: int) -> str:
    try:
        if spark.read.parquet(path).where(F.col(column) == value).limit(1).count():
            raise ValueError(f"{column} {value} is there")
    except AnalysisException as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    return path


def live_segments(manifests: DataFrame) -> DataFrame:
    """The listing of the highest version."""
    newest = manifests.agg(F.max("version").alias("version"))
    return manifests.join(F.broadcast(newest), "version").drop("version")  # one row


def write_tombstones(rows: DataFrame, path: str) -> None:
    """A page of key, reason, eligible_ms more."""
    checked(rows, GC_TOMBSTONE).write.mode("append").parquet(path)


def collectable(tombstones: DataFrame, now: Column) -> DataFrame:
    """key and reason of what may be deleted by now; a key that several pages name waits for the latest."""
    rows = tombstones.groupBy("key").agg(F.max(F.struct("eligible_ms", "reason")).alias("v"))
    return rows.where(F.col("v.eligible_ms") <= now).select("key", "v.reason")


def write_frontier(sections: DataFrame, path: str) -> None:
    """section_id, urlfp, due_ms, priority, a folder for each section; more than MAX_SECTIONS are an error."""
    n = sections.select("section_id").distinct().limit(MAX_SECTIONS + 1).count()
    if n > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} sections")
    sections.select("section_id", "urlfp", "due_ms", "priority").repartition("section_id").sortWithinPartitions("section_id", "due_ms").write.partitionBy("section_id").parquet(path)


def section(frontier: DataFrame, section_id: int) -> DataFrame:
    """One section; the others' folders aren't read."""
    return frontier.where(F.col("section_id") == section_id).drop("section_id")


def write_ledger(fetches: DataFrame, path: str) -> None:
    """urlfp, ts, status, bytes of fetches, appended."""
    checked(fetches, LEDGER).write.mode("append").parquet(path)


def ledger_counts(fetches: DataFrame, key: Column) -> DataFrame:
    """Of each key: fetches, the first and last time, and how many failed (a status of 400 or more)."""
    return fetches.groupBy(key.alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ms"), F.max("ts").alias("last_ms"), F.count_if(F.col("status") >= 400).alias("errors"))


#: Of each folded table: its keys, the values that the newest record sets, and what tells the newest.
SNAPSHOT = {
    "member": (["node"], ["endpoint", "version"]),
    "manifest": (["family", "partition"], ["man_seq"]),
    "generation": (["shard", "generation"], ["kind", "gen_kind"]),
    "commit": (["partition"], ["watermark"]),
}


def snapshot(records: DataFrame) -> DataFrame:
    """table, key, value, seq, ord: the last record of each key of each table of SNAPSHOT, from records with those columns and table.

    Keys and values are JSON, so one table holds all kinds. A snapshot and later records fold to what all records fold to."""
    packed = lambda columns: F.to_json(F.struct(*columns))
    rows = [records.where(F.col("table") == t).select("table", packed(keys).alias("key"), packed(values).alias("value"), "seq", "ord") for t, (keys, values) in SNAPSHOT.items()]
    return newest(reduce(DataFrame.unionAll, rows))


def newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table", "key").agg(F.max(F.struct("seq", "ord", "value")).alias("v")).select("table", "key", "v.value", "v.seq", "v.ord")


def flush(records: DataFrame, path: str, every: int = fold.CHECKPOINT_EVERY) -> int | None:
    """Writes the snapshot at the log's last boundary and returns its seq, None before the first one. Who finds it written already has lost a race, which is as good as having won."""
    at = fold.boundaries(records, every).agg(F.max("seq")).first()[0]
    if at is None:
        return None
    try:
        snapshot(records.where(F.col("seq") <= at)).write.mode("errorifexists").parquet(f"{path}/ckpt_seq={at}")
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return int(at)


def boot(records: DataFrame, path: str, at: int | None) -> DataFrame:
    """The state from the snapshot at a boundary and the records behind it alone."""
    if at is None:
        return snapshot(records)
    before = records.sparkSession.read.parquet(f"{path}/ckpt_seq={at}")
    return newest(before.unionByName(snapshot(records.where(F.col("seq") > at))))


def decoded(lines: DataFrame, column: str = "json") -> DataFrame:
    """Typed records of JSON lines: seq, ord, writer, epoch, kind and the fields of all kinds, null where a kind has none. Lines that aren't records or are of an unknown kind are left out."""
    kind = "struct<seq: bigint, ord: int, kind: string, writer: bigint, epoch: bigint, unit: bigint, node: bigint, deadline_ms: bigint, partition: bigint, family: bigint, man_seq: bigint, shard: bigint, generation: bigint, gen_kind: string, watermark: bigint, endpoint: string, version: bigint, ckpt_seq: bigint>"
    rows = lines.select(F.from_json(F.col(column), kind).alias("r")).select("r.*")
    return rows.where(F.col("kind").isin("member", "lease_grant", "lease_release", "seg_commit", "man_advance", "gen_publish", "gen_retire", "ckpt") & F.col("seq").isNotNull())


def with_table(records: DataFrame) -> DataFrame:
    """decoded() records with the snapshot table that each sets, null for those without one."""
    table = F.when(F.col("kind") == "member", "member").when(F.col("kind") == "man_advance", "manifest").when(F.col("kind").isin("gen_publish", "gen_retire"), "generation").when(F.col("kind") == "seg_commit", "commit")
    return records.withColumn("table", table)
