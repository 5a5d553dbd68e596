"""Queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators.catalog import exclusions
from quarry.plans.common import POSTINGS_SQL, TERMS_SQL, stored, table
from quarry.plans.registry import query

TERMS = ["the", "of", "and", "nicht", "que"]


def _listed(terms):
    return ", ".join(f"'{t}'" for t in sorted(set(terms)))


def _posts(spark, d, terms):
    return stored(spark, d, "postings", terms).select("term", "docid", "tf")


def _topk_sql(terms, k, where="", extra=""):
    times = " ".join(f"WHEN '{t}' THEN {terms.count(t)}" for t in sorted(set(terms)))
    return f"""WITH {POSTINGS_SQL}{extra},
scored AS (SELECT docid, sum(impact * CASE term {times} END)::BIGINT AS score FROM post WHERE term IN ({_listed(terms)}) {where} GROUP BY docid)
SELECT 0::BIGINT AS query_id, row_number() OVER (ORDER BY score DESC, docid)::INT AS rank, docid, least(score, 65535) AS score FROM scored ORDER BY score DESC, docid LIMIT {k}"""


def _topk(terms, k=10):
    def run(spark, d):
        return S.search(_posts(spark, d, terms), S.query_rows(spark, {0: terms}), k)

    return run


for _n in (1, 2, 3, 5):
    query(f"search_topk_{_n}term{'s' * (_n > 1)}", _topk_sql(TERMS[:_n], 10))(_topk(TERMS[:_n]))
query("search_dup_terms", _topk_sql(["the", "the", "of"], 10))(_topk(["the", "the", "of"]))
query("search_absent_term", _topk_sql(["the", "no-such-term"], 10))(_topk(["the", "no-such-term"]))


@query(
    "search_multishard",
    f"""WITH {POSTINGS_SQL},
scored AS (SELECT docid % 4 AS shard, docid // 4 AS local, sum(impact)::BIGINT AS score FROM post WHERE term IN ('the', 'of') GROUP BY ALL),
cut AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, local) AS r FROM scored QUALIFY r <= 20)
SELECT 0::BIGINT AS query_id, row_number() OVER (ORDER BY least(score, 65535) DESC, shard, local)::INT AS rank, (shard << 32) | local AS docid, least(score, 65535) AS score FROM cut ORDER BY rank LIMIT 10""",
)
def search_multishard(spark, d):
    posts = _posts(spark, d, ["the", "of"]).withColumn("shard", F.col("docid") % 4).withColumn("docid", F.floor(F.col("docid") / 4))
    return S.search(posts, S.query_rows(spark, {0: ["the", "of"]}), 10, 20)


@query("search_excluded", _topk_sql(["the", "of"], 10, "AND docid % 7 <> 0 AND docid % 11 <> 0"))
def search_excluded(spark, d):
    """Tombstones of two deltas over one base: their union is excluded."""
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.lit(1).alias("base_docs"))
    deleted = exclusions(ids.where("docid % 7 = 0").unionAll(ids.where("docid % 11 = 0")), 1)
    return S.search(_posts(spark, d, ["the", "of"]), S.query_rows(spark, {0: ["the", "of"]}), 10, deleted=deleted)


@query(
    "search_dev_spam",
    f"SELECT q.* FROM ({_topk_sql(['the', 'of'], 50)}) q LEFT JOIN labels l ON l.doc_id = q.docid WHERE coalesce(l.toxic, 0) = 0",
)
def search_dev_spam(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    values = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("docid"), (F.coalesce("toxic", F.lit(0)) * 255).alias("spam"))
    return S.dev_search(_posts(spark, d, ["the", "of"]), S.query_rows(spark, {0: ["the", "of"]}), values, 50)


@query(
    "search_missing_shard_degrade",
    f"""WITH {POSTINGS_SQL},
scored AS (SELECT docid % 4 AS shard, docid // 4 AS local, sum(impact)::BIGINT AS score FROM post WHERE term IN ('the', 'of') AND docid % 4 IN (0, 2) GROUP BY ALL)
SELECT 0::BIGINT AS query_id, row_number() OVER (ORDER BY score DESC, CASE shard WHEN 2 THEN 0 ELSE 1 END, local)::INT AS rank, (shard << 32) | local AS docid, score, 16 AS degrade FROM scored ORDER BY rank LIMIT 5""",
)
def search_missing_shard_degrade(spark, d):
    asked, mounted = [2, 9, 0], [0, 1, 2, 3]
    posts = _posts(spark, d, ["the", "of"]).withColumn("shard", F.col("docid") % 4).withColumn("docid", F.floor(F.col("docid") / 4))
    return S.search(posts, S.query_rows(spark, {0: ["the", "of"]}), 5, shards=asked).withColumn("degrade", F.lit(S.degrade_bits(spark, asked, mounted)))


@query(
    "search_must_not",
    f"""WITH {POSTINGS_SQL}, s AS (SELECT docid, sum(CASE WHEN term <> 'nicht' THEN impact ELSE 0 END)::BIGINT AS score, count(*) FILTER (term = 'of') AS must, count(*) FILTER (term = 'nicht') AS no FROM post WHERE term IN ('the', 'of', 'nicht') GROUP BY docid)
SELECT 0::BIGINT AS query_id, row_number() OVER (ORDER BY score DESC, docid)::INT AS rank, docid, score FROM s WHERE must = 1 AND no = 0 ORDER BY rank LIMIT 10""",
)
def search_must_not(spark, d):
    """Extension: operators enforced."""
    q = S.query_rows(spark, {0: ["the", ("of", S.MUST), ("nicht", S.NOT)]})
    return S.search(_posts(spark, d, ["the", "of", "nicht"]), q, 10, enforce_ops=True)


@query("search_snippets")
def search_snippets(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("docid"), "text")
    return S.with_snippets(S.search(_posts(spark, d, ["the", "of"]), S.query_rows(spark, {0: ["the", "of"]}), 10), docs)


@query(
    "search_hits_display",
    f"SELECT q.query_id, q.rank, q.docid, q.score, d.lang, d.source FROM ({_topk_sql(['the', 'of'], 10)}) q JOIN documents d ON d.doc_id = q.docid",
)
def search_hits_display(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("docid"), "lang", "source")
    return S.displayed(S.search(_posts(spark, d, ["the", "of"]), S.query_rows(spark, {0: ["the", "of"]}), 10), docs)


@query("search_blockmax", _topk_sql(["the", "of", "and"], 10))
def search_blockmax(spark, d):
    """Block-max pruning in front of the same scores."""
    terms = ["the", "of", "and"]
    return S.pruned_search(_posts(spark, d, terms), stored(spark, d, "blocks", terms), S.query_rows(spark, {0: terms}), 10)


@query("search_maxscore", _topk_sql(TERMS, 10))
def search_maxscore(spark, d):
    """The terms that can't reach the threshold alone are looked up for others' documents only."""
    return S.maxscore_search(_posts(spark, d, TERMS), stored(spark, d, "terms", TERMS), S.query_rows(spark, {0: TERMS}), 10)


@query("search_hybrid", "SELECT * FROM (" + _topk_sql(["the", "of"], 10) + ") UNION ALL SELECT 1::BIGINT AS query_id, * EXCLUDE query_id FROM (" + _topk_sql(TERMS, 10) + ")")
def search_hybrid(spark, d):
    """Up to two terms by block-max, more by MaxScore."""
    return S.hybrid_search(_posts(spark, d, TERMS), stored(spark, d, "terms", TERMS), stored(spark, d, "blocks", TERMS), S.query_rows(spark, {0: ["the", "of"], 1: TERMS}), 10)


@query(
    "search_bounds",
    f"""WITH {TERMS_SQL}, q AS (SELECT unnest(['the', 'of', 'and', 'nicht', 'que']) AS term)
SELECT 0::BIGINT AS query_id, term, bound::BIGINT AS most, sum(bound) OVER (ORDER BY bound, df, term)::BIGINT AS reach FROM terms JOIN q USING (term)""",
)
def search_bounds(spark, d):
    """What a query's weaker terms can reach together."""
    return S.reach(S.query_rows(spark, {0: TERMS}), stored(spark, d, "terms", TERMS)).select("query_id", "term", "most", "reach")


@query(
    "search_traverse_stats",
    f"""WITH {POSTINGS_SQL}, s AS (SELECT docid, sum(impact) AS score FROM post WHERE term IN ('the', 'of') GROUP BY docid)
SELECT 0::BIGINT AS query_id, (SELECT count(*) FROM post WHERE term IN ('the', 'of')) AS postings, count(*) AS docs, max(score)::BIGINT AS best FROM s""",
)
def search_traverse_stats(spark, d):
    """What an exhaustive traversal looks at."""
    return S.traverse_stats(_posts(spark, d, ["the", "of"]), S.query_rows(spark, {0: ["the", "of"]}))


@query(
    "snippet_fanin",
    "SELECT pos, doc_id AS docid, lang, source FROM documents JOIN (SELECT unnest([7, 3, 11, 3, 150]) AS want, unnest(range(5))::INT AS pos) w ON doc_id = want",
)
def snippet_fanin(spark, d):
    """Records in the order that they are asked for, a docid as often as it is asked."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("docid"), "lang", "source")
    return S.records_in_order(docs, [7, 3, 11, 3, 150])


@query(
    "search_batch",
    f"""WITH {POSTINGS_SQL}, found AS (SELECT item_id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}\\p{{Mn}}]+') AS words FROM benchmark)),
q AS (SELECT item_id AS query_id, term FROM found GROUP BY item_id, term QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) <= {S.MAX_TERMS}),
s AS (SELECT query_id, docid, sum(impact)::BIGINT AS score FROM post JOIN q USING (term) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docid)::INT AS rank, docid, least(score, 65535) AS score FROM s QUALIFY rank <= 100""",
)
def search_batch(spark, d):
    """All benchmark items as one batch of queries, top 100 each. A query takes its item's different words, up to the service's limit of terms."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{Nd}\\p{Mn}]+"), F.lit(0))), 1, S.MAX_TERMS)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("term"), F.lit(1).alias("times"), F.lit(S.SHOULD).alias("op"))
    return S.search_batch(stored(spark, d, "postings").select("term", "docid", "tf"), q, 100)
