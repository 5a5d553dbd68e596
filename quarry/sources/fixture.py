"""A synthetic corpus as a pure function of (seed, docid): the shape of a crawl, without its bytes.

Zipf term ranks, log-normal lengths, template near copies, CJK pages, earlier canonicals and power-law links, all from hashes; draws don't depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
START_MS = 1_750_000_000_000
ZIPF, LENGTH_MEAN, LENGTH_SD, LENGTH_LEAST, LENGTH_MOST = 1.07, 5.7, 0.7, 40, 4000
DEGREE_LEAST, DEGREE_MOST, DEGREE_ALPHA = 4, 300, 1.6
TEMPLATE_SHARE, CJK_SHARE, CANON_SHARE = 0.10, 0.05, 0.02
VOCABULARY_LEAST, VOCABULARY_MOST = 200_000, 50_000_000
MEMBER_EVERY = 50


def unit(seed: int, *parts: Column | str) -> Column:
    """A number in (0, 1) for each combination."""
    return (F.pmod(F.xxhash64(F.lit(VERSION), F.lit(seed), *parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def power_index(u: Column, n: Column) -> Column:
    """Index below n; small ones are likely."""
    return F.least(F.floor(F.pow(n.cast("double"), u) - 1), n - 1)


def zipf_rank(u: Column, n: int) -> Column:
    """Rank from 0 of a Zipf law with exponent ZIPF, by inversion of its continuous form."""
    a = 1 - ZIPF
    return F.least(F.floor(F.pow(1 - u * (1 - n**a), F.lit(1 / a))) - 1, F.lit(n - 1)).cast("bigint")


def bounded_pareto(u: Column) -> Column:
    low, high = DEGREE_LEAST**-DEGREE_ALPHA, DEGREE_MOST**-DEGREE_ALPHA
    return F.floor(F.pow(low - u * (low - high), F.lit(-1 / DEGREE_ALPHA))).cast("int")


def spell(rank: Column) -> Column:
    """A word for each rank: base-26 letters."""
    return F.concat(F.lit("w"), F.translate(F.lower(F.conv(rank, 10, 26)), "0123456789", "qrstuvwxyz"))


def doc_freq(rank: Column, n: Column) -> Column:
    """Model of a term's document frequency."""
    return 0.45 * n * F.pow(rank, -0.85)


def corpus(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """docid, url, fetch_ms, status, lang, template, canon_docid, title, text, out_degree."""
    vocabulary = min(max(n // 5, VOCABULARY_LEAST), VOCABULARY_MOST)
    templates, hosts = max(n // 1000, 16), max(n // 50, 4)
    u = lambda name, *c: unit(seed, F.lit(name), "docid", *c)
    rows = spark.range(n).withColumnRenamed("id", "docid")
    rows = rows.withColumn("template", F.when(u("kind") < TEMPLATE_SHARE, F.floor(u("template") * templates)))
    rows = rows.withColumn("cjk", F.col("template").isNull() & (u("kind") >= TEMPLATE_SHARE) & (u("kind") < TEMPLATE_SHARE + CJK_SHARE))
    rows = rows.withColumn("canon_docid", F.when((F.col("docid") > 0) & (u("canon") < CANON_SHARE), power_index(u("target"), F.col("docid"))))
    # Log-normal through Box-Muller.
    normal = F.sqrt(-2 * F.log(u("n1"))) * F.cos(2 * 3.141592653589793 * u("n2"))
    length = F.least(F.greatest(F.floor(F.exp(LENGTH_MEAN + LENGTH_SD * normal)), F.lit(LENGTH_LEAST)), F.lit(LENGTH_MOST)).cast("int")
    # A template's members share its seed and length, but for one token in fifty.
    body_seed = F.coalesce(-1 - F.col("template"), F.col("docid"))
    shared = F.when(F.col("template").isNotNull(), F.lit(400)).otherwise(length)

    def term(i: Column) -> Column:
        own = F.col("template").isNotNull() & (i % MEMBER_EVERY == 0)
        draw = unit(seed, F.lit("term"), F.when(own, F.col("docid")).otherwise(body_seed), i)
        han = F.decode(F.unhex(F.concat(F.lit("e4"), F.hex(F.lit(0xB8) + F.floor(draw * 8)), F.hex(F.lit(0x80) + F.floor(F.pmod(F.xxhash64("docid", i), F.lit(64)))))), "UTF-8")
        return F.when(F.col("cjk"), han).otherwise(spell(zipf_rank(draw, vocabulary)))

    words = F.transform(F.sequence(F.lit(1), shared), term)
    title = F.array_join(F.transform(F.sequence(F.lit(1), (2 + F.floor(u("title") * 7)).cast("int")), lambda i: spell(zipf_rank(unit(seed, F.lit("t"), "docid", i), vocabulary))), " ")
    tail = F.when(u("tail") < 0.5, F.concat(F.lit(" id"), F.lower(F.hex(F.xxhash64(F.lit(seed), "docid"))))).otherwise("")
    url = F.concat(F.lit("https://host"), power_index(u("host"), F.lit(hosts)).cast("string"), F.lit(".test/"), F.col("docid"))
    return rows.select(
        "docid", url.alias("url"), (F.lit(START_MS) + F.col("docid")).alias("fetch_ms"), F.lit(200).alias("status"), F.when(F.col("cjk"), 2).otherwise(1).alias("lang"), "template", "canon_docid",
        title.alias("title"), F.concat(F.when(F.col("cjk"), F.array_join(words, "")).otherwise(F.array_join(words, " ")), tail).alias("text"), bounded_pareto(u("degree")).alias("out_degree"),
    )


def outlinks(pages: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """src, dst of the synthetic links: targets by a power law over all docids."""
    slots = pages.select(F.col("docid").alias("src"), F.explode(F.sequence(F.lit(1), "out_degree")).alias("slot"))
    return slots.select("src", power_index(unit(seed, F.lit("link"), "src", "slot"), F.lit(n)).cast("bigint").alias("dst")).distinct()


def digest(pages: DataFrame, column: str = "text", order: str = "docid") -> DataFrame:
    """One hash of all rows' hashes in order; rows are hashed first, in 4096-row groups, so no task gathers the texts."""
    each = pages.select(F.col(order).alias("k"), F.sha2(F.col(column), 256).alias("h"))
    groups = each.groupBy(F.floor(F.col("k") / 4096).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))
