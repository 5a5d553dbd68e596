"""Fields and links of raw HTML, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import anchor_cut
from quarry.schemas import MAX_OUTLINKS


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def text_of(html: Column) -> Column:
    """Text without scripts, styles, the title and tags."""
    bare = F.regexp_replace(html, "<(script|style|title)[^>]*>[^<]*</(script|style|title)>", " ")
    return F.regexp_replace(bare, "<[^>]*>", " ")


def page_fields(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", title_of(F.col("html")).alias("title"), text_of(F.col("html")).alias("text"))


def rel_flags(rel: Column) -> Column:
    """1 nofollow, 2 ugc, 4 sponsored."""
    return sum((F.when(rel.contains(w), v).otherwise(0) for w, v in (("nofollow", 1), ("ugc", 2), ("sponsored", 4))), F.lit(0))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, anchor, flags (1 nofollow, 2 ugc, 4 sponsored) of every link, in order."""
    found = F.slice(F.regexp_extract_all(F.col("html"), F.lit("(?s)<a [^>]*href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0)), 1, MAX_OUTLINKS)
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "tag"))
    rel = F.regexp_extract("tag", "rel=\"([^\"]*)\"", 1)
    flags = rel_flags(rel)
    text = F.regexp_replace(F.regexp_extract("tag", "(?s)>(.*)</a>", 1), "<[^>]*>", "")
    return rows.select("page_id", "url", "pos", F.regexp_extract("tag", "href=\"([^\"]*)\"", 1).alias("href"), anchor_cut(text).cast("string").alias("anchor"), flags.alias("flags"))


def wat_links(records: DataFrame, column: str = "json") -> DataFrame:
    """Link rows of metadata records as JSON: anchors only, with the flags that rel sets."""
    kind = "struct<Envelope: struct<`Payload-Metadata`: struct<`HTTP-Response-Metadata`: struct<`HTML-Metadata`: struct<Links: array<struct<path: string, url: string, text: string, rel: string>>>>>>>"
    found = F.from_json(F.col(column), kind)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]
    kept = F.filter(found, lambda x: x["path"] == "A@/href")
    return records.select("*", F.posexplode(kept).alias("pos", "link")).select("*", F.col("link.url").alias("href"), F.col("link.text").alias("anchor"), rel_flags(F.coalesce(F.col("link.rel"), F.lit(""))).alias("flags")).drop("link", column)
