"""Operator 6: line dedup over levelled sorted runs of line hashes, with DataFrame functions alone.

Documents come in batches, by ascending id. A run is a table of the hashes that some batches hold, sorted by hash. A new batch
merge-anti-joins the runs (a line whose hash a run has is a repeat of an earlier document), then its own new hashes become a run of level 0.
When a level has FANOUT runs they are compacted into one run of the next level, so a batch meets few runs however many there were."""

from __future__ import annotations

import gc
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textops as X

#: Batches of documents, and runs of a level that are compacted into one.
BATCHES = 4
FANOUT = 2
#: Code points that a key needs to count.
LEAST = 10
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or where that is unset (tests) in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return f"{base.rstrip('/')}/{uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def save(rows: DataFrame, path: str) -> DataFrame:
    """Writes rows to the scratch folder, packed well, and reads them again."""
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later result reads."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hash_pair(key: Column) -> list[Column]:
    """128 bits that stand for a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def numbered(docs: DataFrame) -> DataFrame:
    """One row for each line of each distinct (doc_id, text): doc_id, t (the text's hash), pos from 0, h1, h2; keys too short have none."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= LEAST)
    return keyed.select("doc_id", "t", "pos", *hash_pair(F.col("key")))


class Runs:
    """The levelled runs: parquet tables in a shared folder, each sorted by hash."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.levels, self.made = spark, folder, [], 0

    def tables(self) -> list[DataFrame]:
        return [self.spark.read.parquet(p) for level in self.levels for p in level]

    def write(self, hashes: DataFrame) -> str:
        path = f"{self.folder}/run-{self.made:05d}"
        self.made += 1
        hashes.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def add(self, hashes: DataFrame, level: int = 0) -> None:
        """hashes: distinct, and in no run yet."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.write(hashes))
        if len(self.levels[level]) >= FANOUT:
            merged = reduce(DataFrame.unionAll, [self.spark.read.parquet(p) for p in self.levels[level]])
            self.levels[level] = []
            self.add(merged.repartition("h1"), level + 1)


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, t, pos of every line that goes."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    runs = Runs(spark, folder)
    edges = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("e")).first().e or []
    bounds = [None, *sorted(set(edges)), None]
    # One pass over the texts: the lines of each batch in its own folder.
    batch = reduce(lambda n, e: n + (F.col("doc_id") > e).cast("int"), bounds[1:-1], F.lit(0))
    numbered(docs).withColumn("batch", batch).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("doc_id long, t long, pos int, h1 long, h2 long, batch int").parquet(f"{folder}/lines")
    gone = []
    for i in range(len(bounds) - 1):
        here = lines.where(F.col("batch") == i).drop("batch")
        owners = here.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        fresh = reduce(lambda d, run: d.join(run.hint("merge"), ["h1", "h2"], "left_anti"), runs.tables(), owners)
        path = f"{folder}/fresh-{i}"
        fresh.write.parquet(path)
        fresh = spark.read.parquet(path)
        gone.append(here.join(fresh.hint("merge"), ["h1", "h2"], "left").where("owner IS NULL OR owner < doc_id").select("doc_id", "t", "pos"))
        if i < len(bounds) - 2:
            runs.add(fresh.select("h1", "h2"))
    return reduce(DataFrame.unionAll, gone)


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with two columns more, n_lines and n_dropped, and text without the lines that an earlier document has.

    A text is split at line feeds; a null or empty one is one empty line and stays as it is, as does one that loses nothing. Lines whose key (blanks stripped, A-Z
    lowered) has LEAST code points or more stay only in the smallest doc_id that holds the key, there all of them. Rows with the same doc_id are
    one document. A row with a null id is kept whole and takes no part. An input column named n_lines or n_dropped is replaced; other names may be any. An empty table gives none."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    of, of_t, gone_at, n_lines = X.fresh(docs, 4)
    gone = dropped_lines(docs.select("doc_id", "text"), batches).groupBy(F.col("doc_id").alias(of), F.col("t").alias(of_t)).agg(F.collect_set("pos").alias(gone_at))
    both = docs.select(keep).join(gone, (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(of_t)), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # A set's difference keeps the order: as many steps as there are lines.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_at))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(kept)
    out = both.withColumn(n_lines, F.size(lines).cast("long"))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in keep], F.col(n_lines).alias("n_lines"), F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at)).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' lines, and the SHA-256 of what is kept (null: of the empty text); the cases are those of dedup_lines()."""
    out = dedup_lines(X.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, len(parts) AS n, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), owner AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT l.*, o.owner IS NOT NULL AND o.owner < l.doc_id AS gone FROM lines l LEFT JOIN owner o ON l.key = o.key)
SELECT doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
