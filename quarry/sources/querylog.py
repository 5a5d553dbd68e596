"""Query logs: reading, and synthesis from document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ordered import numbered
from quarry.sources.stored import saved

#: Lengths that are drawn, each as likely as the others; fixed.
LENGTHS = [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5]


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """One query for each line that is neither blank nor a comment: value, terms."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '#')")
    return lines.select("value", F.split("value", r"\s+").alias("terms"))


def bands(terms: DataFrame) -> DataFrame:
    """rank from 0 by df descending, and band: head (the first hundredth, one term at least), torso (to a fifth), tail."""
    terms = saved(terms.select("term", "df"))  # read three times; counting them takes all texts
    ranked = numbered(terms, [F.desc("df"), F.col("term")], "rank")
    n = terms.agg(F.count(F.lit(1)).alias("n"))
    both = ranked.crossJoin(F.broadcast(n))  # one row
    head = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / 100))
    torso = F.least(F.greatest(F.floor(F.col("n") / 5), head + 1), F.col("n"))
    return both.select("term", "df", "rank", F.when(F.col("rank") < head, "head").when(F.col("rank") < torso, "torso").otherwise("tail").alias("band"), head.alias("head"), torso.alias("torso"), "n")


def synthesize(terms: DataFrame, queries: int, seed: int = 1) -> DataFrame:
    """query_id, terms: 60 % of the draws from the head, 30 % from the torso, 10 % from all terms; a query's terms are distinct, so it may be shorter than drawn.

    Draws are hashes of (seed, query, slot), so the log is a function of its arguments."""
    spark = terms.sparkSession
    ranked = saved(bands(terms))
    sizes = ranked.select("head", "torso", "n").limit(1)
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / float(1 << 30)
    ids = spark.range(queries).withColumnRenamed("id", "query_id")
    length = F.element_at(F.array(*map(F.lit, LENGTHS)), (F.floor(unit("query_id", F.lit("length")) * len(LENGTHS)) + 1).cast("int"))
    slots = ids.select("query_id", F.explode(F.sequence(F.lit(1), length)).alias("slot")).crossJoin(F.broadcast(sizes))
    u, v = unit("query_id", "slot", F.lit("band")), unit("query_id", "slot", F.lit("term"))
    rank = F.when(u < 0.6, F.floor(v * F.col("head"))).when(u < 0.9, F.col("head") + F.floor(v * (F.col("torso") - F.col("head")))).otherwise(F.floor(v * F.col("n")))
    drawn = slots.select("query_id", "slot", F.least(rank, F.col("n") - 1).cast("bigint").alias("rank"))
    got = drawn.join(ranked.select(F.col("rank").cast("bigint").alias("rank"), "term"), "rank")
    return got.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("slot", "term"))), lambda x: x["term"])).alias("terms"))
