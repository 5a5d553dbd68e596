"""Queries of import, dedup, links and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import url as U
from quarry.functions.hashing import anchor_cut, fingerprint, fnv32, rfc3339_ms
from quarry.operators import graph as G
from quarry.operators import ingest as N
from quarry.operators import store as C
from quarry.plans.common import table
from quarry.plans.registry import query
from quarry.sources.html import links, page_fields, wat_links
from quarry.sources.stored import scratch
from quarry.sources.warc import packed, parsed

_KEYS = ", ".join(f"'{k}'" for k in U.TRACKING + U.SESSION)
#: The laws for the URL shapes of the table: no escapes, dot segments or user names.
CANON_SQL = rf"""
parts AS (SELECT page_id, url, html, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
canon AS (SELECT page_id, html, u.query AS query, regexp_replace(lower(u.host), CASE lower(u.scheme) WHEN 'http' THEN ':80$' ELSE ':443$' END, '') AS host,
  array_to_string(list_filter(string_split(u.query, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({_KEYS}) AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT starts_with(lower(split_part(p, '=', 1)), 'aspsessionid')), '&') AS kept,
  lower(u.scheme) AS scheme, CASE WHEN u.path = '' THEN '/' ELSE regexp_replace(u.path, '/+', '/', 'g') END AS path FROM parts),
page AS (SELECT *, scheme || '://' || host || path || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url_canon FROM canon)"""
FNV32_SQL = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: xor(a, x) * 16777619 % 4294967296)"


def _canon(spark, d):
    return table(spark, d, "pages").withColumn("url_canon", U.canonicalize_url(F.col("url")))


@query("url_canon", f"WITH {CANON_SQL} SELECT page_id, url_canon FROM page")
def url_canon(spark, d):
    return _canon(spark, d).select("page_id", "url_canon")


@query("url_strip_params", f"WITH {CANON_SQL} SELECT page_id, kept FROM page")
def url_strip_params(spark, d):
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    return table(spark, d, "pages").select("page_id", U.kept_query(q).alias("kept"))


@query("url_fp", f"WITH {CANON_SQL} SELECT page_id, substr(sha256(url_canon), 1, 32) AS urlfp FROM page")
def url_fp(spark, d):
    return _canon(spark, d).select("page_id", fingerprint(F.col("url_canon")).alias("urlfp"))


@query("host_partition", f"WITH {CANON_SQL} SELECT page_id, regexp_replace(host, ':[0-9]*$', '') AS host, ({FNV32_SQL.format(chr(39).join(['regexp_replace(host, ', ':[0-9]*$', ', ', '', ')']))} % 16)::INT AS part FROM page")
def host_partition(spark, d):
    return _canon(spark, d).select("page_id", U.host_of(F.col("url_canon")).alias("host"), U.host_partition(F.col("url_canon"), 16).alias("part"))


@query("scalar_hashes", f"SELECT item_id, sha256(text) AS sha, ({FNV32_SQL.format('item_id::VARCHAR')})::BIGINT AS fnv, lpad(item_id::VARCHAR, 16, '0') AS object_key, encode(text)[1:64]::VARCHAR <> '' AS some FROM benchmark")
def scalar_hashes(spark, d):
    from quarry.functions.hashing import object_key

    rows = table(spark, d, "benchmark")
    return rows.select("item_id", F.sha2("text", 256).alias("sha"), fnv32(F.col("item_id").cast("string")).alias("fnv"), object_key(F.col("item_id")).alias("object_key"), (F.octet_length(anchor_cut(F.col("text"), 64)) > 0).alias("some"))


@query("dates_to_ms", "SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS ms, 0::BIGINT AS bad, (ts::DATE - DATE '2000-01-01')::INT AS days FROM events")
def dates_to_ms(spark, d):
    from quarry.functions.hashing import days_since_2000

    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", rfc3339_ms(text).alias("ms"), rfc3339_ms(F.lit("no date")).alias("bad"), days_since_2000(F.to_date("ts")).alias("days"))


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, source, sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY source, sha256(text)")
def dedup_exact(spark, d):
    rows = table(spark, d, "documents").withColumn("sha", F.sha2("text", 256))
    return N.copies(rows, ["source", "sha"], "doc_id")


@query("dedup_first_wins", "SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) > 1 AS dup FROM documents")
def dedup_first_wins(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return N.first_wins(rows, ["source", "sha"], "doc_id").select("doc_id", "dup")


def _records(spark, d):
    """Pages as records in order, with repeats, short texts and other schemes among them."""
    pages = table(spark, d, "pages")
    again = pages.where("page_id % 5 = 0").select((F.col("page_id") + 1_000_000).alias("arrival"), "url", F.col("html").alias("text"))
    first = pages.select(F.col("page_id").alias("arrival"), F.when(F.col("page_id") % 11 == 0, "ftp://x.test/").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 == 0, "short").otherwise(F.col("html")).alias("text"))
    return first.unionByName(again)


_RECORDS_SQL = f"""{CANON_SQL}, r AS (
  SELECT page_id AS arrival, url_canon, html AS text, page_id % 7 = 0 AS short, page_id % 7 <> 0 AND page_id % 11 = 0 AS rejected, host FROM page
  UNION ALL SELECT page_id + 1000000, url_canon, html, false, false, host FROM page WHERE page_id % 5 = 0),
m AS (SELECT *, NOT short AND NOT rejected AND row_number() OVER (PARTITION BY short OR rejected, url_canon, sha256(text) ORDER BY arrival) > 1 AS dup FROM r)"""


@query("import_stats", f"WITH {_RECORDS_SQL} SELECT count(*) FILTER (NOT short AND NOT rejected AND NOT dup) AS pages, count(*) FILTER (dup) AS dups, count(*) FILTER (rejected) AS rejected, count(*) FILTER (short) AS short FROM m")
def import_stats(spark, d):
    return N.statistics(N.hashed(N.outcomes(_records(spark, d)), 16), N.PAGE_KEYS)


@query("import_pages", f"WITH {_RECORDS_SQL} SELECT arrival, substr(sha256(url_canon), 1, 32) AS urlfp, sha256(text) AS sha FROM m WHERE NOT short AND NOT rejected AND NOT dup")
def import_pages(spark, d):
    rows = N.hashed(N.outcomes(_records(spark, d)).where("outcome = 'kept'"), 16)
    return N.firsts(rows, N.PAGE_KEYS).select("arrival", "urlfp", "sha")


def _crawl(spark, d):
    """The records as a crawl's WARC files of 50 at most, taken apart again; places in a file begin anew with each."""
    rows = _records(spark, d).select(F.lpad(F.expr("arrival DIV 50").cast("string"), 12, "0").alias("file"), F.col("arrival").alias("at"), "url", "text")
    return parsed(packed(rows.select("*", F.lit("conversion").alias("type"), F.lit("2026-01-02T03:04:05Z").alias("date"))))


_CRAWL_SQL = f"""{_RECORDS_SQL},
k AS (SELECT *, ({FNV32_SQL.format("regexp_replace(host, ':[0-9]*$', '')")} % 16)::INT AS partition FROM m WHERE NOT short AND NOT rejected AND NOT dup),
sealed AS (SELECT *, (row_number() OVER (PARTITION BY partition ORDER BY arrival) - 1) // 5 + 1 AS seq FROM k)"""


@query("import_crawl", f"WITH {_CRAWL_SQL} SELECT row_number() OVER (ORDER BY partition, seq, arrival) - 1 AS docid, partition, seq, url_canon AS url, sha256(text) AS sha FROM sealed")
def import_crawl(spark, d):
    """Many files with a global order of arrival, segments of five rows, docids by arrival."""
    pages = N.docids(N.import_records(_crawl(spark, d), 16, max_rows=5))
    return pages.select("docid", "partition", "seq", "url", F.lower(F.hex("sha256")).alias("sha"))


@query(
    "import_crawl_stats",
    f"WITH {_CRAWL_SQL} SELECT count(*) FILTER (NOT short AND NOT rejected AND NOT dup) AS pages, count(*) FILTER (dup) AS dups, count(*) FILTER (rejected) AS rejected, count(*) FILTER (short) AS short, (SELECT count(DISTINCT (partition, seq)) FROM sealed) AS segments FROM m",
)
def import_crawl_stats(spark, d):
    return N.import_statistics(_crawl(spark, d), 16, max_rows=5)


@query(
    "segments_seal",
    "WITH s AS (SELECT *, (row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1) // 100 + 1 AS seq FROM documents) SELECT (doc_id % 4)::INT AS partition, seq, count(*) AS n, sum(strlen(text))::BIGINT AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM s GROUP BY ALL",
)
def segments_seal(spark, d):
    rows = table(spark, d, "documents").withColumn("partition", (F.col("doc_id") % 4).cast("int"))
    seq = N.segment_numbers(rows, "doc_id", 100)
    return seq.groupBy("partition", "seq").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("segments_by_bytes")
def segments_by_bytes(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 4).cast("int").alias("partition"), F.col("doc_id").alias("arrival"), "text", F.lit("").alias("url"))
    return N.segments(rows.withColumn("_size", N.size_of()), ["arrival"], max_rows=100, max_bytes=200_000).select("partition", "arrival", "seq")


BITS_SQL = r"""
toks AS (SELECT doc_id, unnest(regexp_split_to_array(trim(text, chr(32) || chr(10) || chr(9) || chr(13)), '\s+')) AS tok FROM documents),
uniq AS (SELECT tok, hex(encode(tok)) AS hx FROM (SELECT DISTINCT tok FROM toks WHERE tok <> '')),
fnv AS (SELECT tok, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(length(hx) // 2), lambda i: ((instr('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1)::UHUGEINT)), lambda a, x: xor(a, x) * 1099511628211 % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM uniq),
cnt AS (SELECT doc_id, tok, count(*) AS n FROM toks WHERE tok <> '' GROUP BY ALL),
bits AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS v FROM cnt JOIN fnv USING (tok), range(64) r(b) GROUP BY ALL),
sim AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END) AS h FROM bits GROUP BY doc_id)"""


@query("simhash", f"WITH {BITS_SQL} SELECT doc_id AS docid, lower(lpad(hex(h), 16, '0')) AS simhash FROM sim")
def simhash(spark, d):
    return G.simhashes(table(spark, d, "documents")).select("docid", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


@query("near_dup_pairs", f"WITH {BITS_SQL}, r AS (SELECT DISTINCT h FROM sim) SELECT lower(lpad(hex(least(a.h, b.h)), 16, '0')) AS a, lower(lpad(hex(greatest(a.h, b.h)), 16, '0')) AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM r a JOIN r b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 3")
def near_dup_pairs(spark, d):
    """Pairs of distinct hashes; near_dup_classes has who they are."""
    h = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    pairs = G.near_pairs(G.simhashes(table(spark, d, "documents")))
    return pairs.select(F.least(h("a"), h("b")).alias("a"), F.greatest(h("a"), h("b")).alias("b"), F.col("distance").cast("int").alias("distance"))


@query("near_dup_classes", f"WITH {BITS_SQL} SELECT doc_id AS docid, min(doc_id) OVER (PARTITION BY h) AS class_id FROM sim")
def near_dup_classes(spark, d):
    return G.members(G.simhashes(table(spark, d, "documents"))).select("docid", "class_id")


_LINKS_SQL = r"""links AS (SELECT page_id, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, regexp_replace(regexp_extract(tag, '(?s)>(.*)</a>', 1), '<[^>]*>', '', 'g') AS anchor
  FROM (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags)))::INT AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a [^>]*href="[^"]*"[^>]*>.*?</a>') AS tags FROM pages)))"""


@query("outlinks", f"WITH {_LINKS_SQL} SELECT page_id, pos, href, anchor, 0 AS flags FROM links")
def outlinks(spark, d):
    return links(table(spark, d, "pages")).select("page_id", "pos", "href", "anchor", "flags")


def _edges(spark, d):
    return G.edges(links(table(spark, d, "pages")).select(F.col("page_id").cast("string").alias("src"), F.col("href").alias("dst")))


@query("adjacency", f"WITH {_LINKS_SQL} SELECT page_id::VARCHAR AS src, array_to_string(list(DISTINCT href ORDER BY href), ' ') AS dsts FROM links GROUP BY page_id")
def adjacency(spark, d):
    return G.adjacency(_edges(spark, d)).select("src", F.array_join("dsts", " ").alias("dsts"))


@query("degrees", f"WITH {_LINKS_SQL}, e AS (SELECT DISTINCT page_id::VARCHAR AS src, href AS dst FROM links), b AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM b GROUP BY node")
def degrees(spark, d):
    return G.degrees(_edges(spark, d))


@query("graph_stats", f"WITH {_LINKS_SQL}, e AS (SELECT DISTINCT page_id::VARCHAR AS src, href AS dst FROM links) SELECT count(DISTINCT src) AS n_src, count(*) AS n_edges, min(src) AS first, max(src) AS last FROM e")
def graph_stats(spark, d):
    return G.graph_stats(_edges(spark, d))


@query("pagerank")
def pagerank(spark, d):
    """Extension."""
    return G.pagerank(_edges(spark, d), 3)


@query("docmap", f"WITH {CANON_SQL} SELECT substr(sha256(url_canon), 1, 32) AS urlfp, min(page_id) AS docid FROM page GROUP BY 1")
def docmap(spark, d):
    return G.docmap(table(spark, d, "pages"), "page_id", U.canonicalize_url(F.col("url")))


def _docmap_rows(spark, d):
    """Identities of the pages as a docmap's rows."""
    return _canon(spark, d).select(F.unhex(fingerprint(F.col("url_canon"))).alias("urlfp"), F.col("page_id").alias("docid"), F.lit(None).cast("binary").alias("canon_fp"), F.lit(0).alias("flags"))


def _stored_docmap(spark, d, rows=None):
    folder = scratch(spark)
    C.write_docmap(_docmap_rows(spark, d) if rows is None else rows, folder)
    return spark.read.parquet(folder)


@query("docmap_find", f"WITH {CANON_SQL}, m AS (SELECT url_canon, min(page_id) AS docid FROM page GROUP BY 1) SELECT docid, substr(sha256(url_canon), 1, 32) AS urlfp FROM m WHERE url_canon IN (SELECT url_canon FROM page WHERE page_id IN (3, 17))")
def docmap_find(spark, d):
    """A stored docmap, asked for two fingerprints."""
    wanted = [bytes(r.urlfp) for r in _docmap_rows(spark, d).where("docid IN (3, 17)").collect()]
    return C.find(_stored_docmap(spark, d), wanted).select("docid", F.lower(F.hex("urlfp")).alias("urlfp"))


@query("docmap_merge", f"WITH {CANON_SQL}, a AS (SELECT substr(sha256(url_canon), 1, 32) AS urlfp, min(page_id) AS docid FROM page GROUP BY 1), b AS (SELECT substr(sha256(url_canon), 1, 32) AS urlfp, min(page_id) + 1000 AS docid FROM page WHERE page_id % 3 = 0 GROUP BY 1) SELECT urlfp, coalesce(b.docid, a.docid) AS docid FROM a LEFT JOIN b USING (urlfp)")
def docmap_merge(spark, d):
    """Two generations: of an identity that both have the newer one's row counts."""
    rows = _docmap_rows(spark, d)
    newer = rows.where("docid % 3 = 0").withColumn("docid", F.col("docid") + 1000)
    both = C.merged_docmap([_stored_docmap(spark, d, rows), _stored_docmap(spark, d, newer)])
    return both.select(F.lower(F.hex("urlfp")).alias("urlfp"), "docid")


@query("graph_walk", f"WITH {_LINKS_SQL} SELECT DISTINCT page_id::VARCHAR AS src, href AS dst FROM links")
def graph_walk(spark, d):
    """The stored graph, source by source."""
    folder = scratch(spark)
    C.write_graph(_edges(spark, d), folder)
    return G.walk(G.adjacency(spark.read.parquet(folder)))


@query(
    "in_degree_of_pages",
    f"WITH {_LINKS_SQL} SELECT href AS urlfp, count(*) AS in_degree FROM links WHERE href IN (SELECT href FROM links WHERE page_id % 2 = 0) GROUP BY href",
)
def in_degree_of_pages(spark, d):
    """Pages here are the targets of every second page's links."""
    rows = links(table(spark, d, "pages"))
    pages = rows.where("page_id % 2 = 0").select(F.col("href").alias("urlfp")).distinct()
    return G.in_degree_of_pages(rows.select(F.col("href").alias("dst")), pages)


@query("raw_get", "SELECT page_id AS docid, sha256(html) AS sha, strlen(html)::BIGINT AS len FROM pages WHERE page_id BETWEEN 10 AND 12")
def raw_get(spark, d):
    """Stored HTML of three pages; the filter reaches the scan."""
    folder = scratch(spark)
    C.write_raw(table(spark, d, "pages").withColumnRenamed("page_id", "docid"), folder)
    return spark.read.parquet(folder).where("docid BETWEEN 10 AND 12").select("docid", F.sha2("html", 256).alias("sha"), "len")


@query("wat_links", f"WITH {_LINKS_SQL} SELECT page_id, pos, href, anchor, CASE WHEN page_id % 3 = 0 THEN 5 ELSE 0 END AS flags FROM links")
def wat_query(spark, d):
    """Links as the JSON of metadata records, images between them, taken apart again with their flags."""
    one = F.struct(F.lit("A@/href").alias("path"), F.col("href").alias("url"), F.col("anchor").alias("text"), F.when(F.col("page_id") % 3 == 0, "nofollow sponsored").alias("rel"))
    other = F.struct(F.lit("IMG@/src").alias("path"), F.lit("x.png").alias("url"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("rel"))
    rows = links(table(spark, d, "pages")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("link")))).alias("l"))
    found = F.flatten(F.transform("l", lambda x: F.array(other, x["link"])))
    json = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(found.alias("Links")).alias("HTML-Metadata")).alias("HTTP-Response-Metadata")).alias("Payload-Metadata")).alias("Envelope")))
    return wat_links(rows.select("page_id", json.alias("json"))).select("page_id", "pos", "href", "anchor", "flags")


@query("point_lookup", "SELECT page_id, url FROM pages WHERE page_id = 42")
def point_lookup(spark, d):
    """The filter and the two columns reach the scan."""
    return table(spark, d, "pages").where("page_id = 42").select("page_id", "url")


@query("page_fields", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, d):
    return page_fields(table(spark, d, "pages")).select("page_id", "title")
