"""Queries of the text and index operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index as I
from quarry.plans.common import BLOCKS_SQL, POSTINGS_SQL, TERMS_SQL, TOKENS_SQL, doc_postings, doc_tokens, table
from quarry.plans.registry import query

CJK_ROWS = "(1, '東京タワーに行く'), (2, 'カ'), (3, 'mixed 漢字 and kana かな text'), (4, '한국어 words'), (5, 'ﬁne ①')"


@query("tok_terms", f"WITH {TOKENS_SQL} SELECT docid, term, count(*) AS n FROM tok GROUP BY ALL")
def tok_terms(spark, d):
    return doc_tokens(spark, d).groupBy("docid", "term").agg(F.count(F.lit(1)).alias("n"))


@query("tok_positions", f"WITH {TOKENS_SQL} SELECT docid, pos, term FROM tok")
def tok_positions(spark, d):
    return doc_tokens(spark, d).select("docid", "pos", "term")


@query("tok_class_hist", f"WITH {TOKENS_SQL} SELECT class, count(*) AS n FROM classed GROUP BY class")
def tok_class_hist(spark, d):
    return T.positioned(table(spark, d, "documents"), ["doc_id"]).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("tok_cjk_bigrams", "SELECT * FROM (VALUES (1, 0, '東京'), (1, 1, '京タ'), (1, 2, 'タワ'), (1, 3, 'ー'), (1, 4, 'に行'), (1, 5, '行く'), (2, 0, 'カ'), (3, 0, 'mixed'), (3, 1, '漢字'), (3, 2, 'and'), (3, 3, 'kana'), (3, 4, 'かな'), (3, 5, 'text'), (4, 0, '한국어'), (4, 1, 'words'), (5, 0, 'fine'), (5, 1, '1')) t(id, pos, term)")
def tok_cjk_bigrams(spark, d):
    return T.admitted(spark.sql(f"SELECT * FROM VALUES {CJK_ROWS} AS t(id, text)"), ["id"])


@query("idx_postings", f"WITH {POSTINGS_SQL} SELECT term, docid, tf, impact FROM post")
def idx_postings(spark, d):
    return doc_postings(spark, d).select("term", "docid", "tf", "impact")


@query("idx_position_lists", f"WITH {TOKENS_SQL} SELECT term, docid, array_to_string(list(DISTINCT least(pos, 65535) ORDER BY least(pos, 65535)), ' ') AS body_pos FROM tok GROUP BY term, docid")
def idx_position_lists(spark, d):
    return I.postings(doc_tokens(spark, d), True).select("term", "docid", F.array_join(F.col("body_pos").cast("array<string>"), " ").alias("body_pos"))


@query("idx_terms_df_cf", f"WITH {TERMS_SQL} SELECT term, df, cf, bound FROM terms")
def idx_terms_df_cf(spark, d):
    return I.terms(doc_postings(spark, d)).select("term", "df", "cf", "bound")


@query("idx_totals", f"WITH {TERMS_SQL} SELECT count(*) AS term_count, sum(df)::BIGINT AS posting_count, sum(cf)::BIGINT AS token_count FROM terms")
def idx_totals(spark, d):
    return I.terms(doc_postings(spark, d)).agg(F.count(F.lit(1)).alias("term_count"), F.sum("df").alias("posting_count"), F.sum("cf").alias("token_count"))


@query("idx_fieldstats", f"WITH {TOKENS_SQL} SELECT 0 AS field, count(*) AS sum_len, (SELECT count(*) FROM documents) AS doc_count, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS avg_len FROM tok")
def idx_fieldstats(spark, d):
    return I.field_stats(table(spark, d, "documents"), doc_tokens(spark, d))


@query(
    "idx_doclen",
    f"WITH {TOKENS_SQL}, c AS (SELECT doc_id AS docid, count(term) AS n FROM documents LEFT JOIN tok ON docid = doc_id GROUP BY doc_id) SELECT docid, 128 AS quality, 0 AS spam, least(CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END, 255)::INT AS doclen_body, 0 AS doclen_title FROM c",
)
def idx_doclen(spark, d):
    return I.doc_values(table(spark, d, "documents"), doc_tokens(spark, d))


_TWO = r"""WITH p AS (SELECT page_id AS docid, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(regexp_replace(html, '<(script|style|title)[^>]*>[^<]*</(script|style|title)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS text FROM pages),
f AS (SELECT docid, 0 AS field, regexp_extract_all(lower(text), '[\p{L}\p{Nd}\p{Mn}]+') AS found FROM p UNION ALL SELECT docid, 1, regexp_extract_all(lower(title), '[\p{L}\p{Nd}\p{Mn}]+') FROM p),
t AS (SELECT docid, field, unnest(found) AS term FROM f)
SELECT term, docid, count(*)::INT AS tf, bit_or(1 << field)::INT AS mask FROM t WHERE strlen(term) <= 64 AND NOT (length(term) >= 24 AND regexp_full_match(term, '[\p{L}0-9]+') AND regexp_matches(term, '[0-9]') AND regexp_matches(term, '\p{L}')) AND NOT (regexp_full_match(term, '[0-9]+') AND length(term) > 16) GROUP BY term, docid"""


@query("idx_two_field_mask", _TWO)
def idx_two_field_mask(spark, d):
    from quarry.sources.html import page_fields

    return I.postings(I.tokens(page_fields(table(spark, d, "pages")), "page_id", "text", "title")).select("term", "docid", "tf", "mask")


@query("idx_blocks_l1", f"WITH {BLOCKS_SQL} SELECT * FROM blocks")
def idx_blocks_l1(spark, d):
    return I.blocks(doc_postings(spark, d))


@query("idx_blocks_l2", f"WITH {BLOCKS_SQL} SELECT term, block_id // 32 AS l2_id, max(last_docid) AS last_docid, max(max_impact) AS max_impact, count(*) AS blocks FROM blocks GROUP BY term, block_id // 32")
def idx_blocks_l2(spark, d):
    return I.superblocks(I.blocks(doc_postings(spark, d)))


@query("idx_bounds", f"WITH {BLOCKS_SQL} SELECT term, max(max_impact) AS bound FROM blocks GROUP BY term")
def idx_bounds(spark, d):
    return I.superblocks(I.blocks(doc_postings(spark, d))).groupBy("term").agg(F.max("max_impact").alias("bound"))


@query("idx_gaps", f"WITH {POSTINGS_SQL} SELECT term, docid, docid - coalesce(lag(docid) OVER (PARTITION BY term ORDER BY docid), 0) AS gap FROM post")
def idx_gaps(spark, d):
    return I.gaps(doc_postings(spark, d))


@query("idx_inline_terms", f"WITH {TERMS_SQL} SELECT inlined, count(*) AS n, sum(df)::BIGINT AS postings FROM terms GROUP BY inlined")
def idx_inline_terms(spark, d):
    return I.terms(doc_postings(spark, d)).groupBy("inlined").agg(F.count(F.lit(1)).alias("n"), F.sum("df").alias("postings"))


@query("idx_head_terms", f"WITH {TERMS_SQL}, h AS (SELECT term, df, sum(ceil(df / 128.0) * 8) OVER (ORDER BY df DESC, term) AS running FROM terms WHERE df >= 100) SELECT term, df, running::BIGINT AS running FROM h WHERE running <= 1000")
def idx_head_terms(spark, d):
    return I.head_budget(I.terms(doc_postings(spark, d)), 100, 1000).select("term", "df", F.col("running").cast("bigint").alias("running"))


@query("idx_term_lookup", f"WITH {TERMS_SQL} SELECT term, df, cf FROM terms WHERE term IN ('the', 'of', 'nicht', 'quell', 'absent-term')")
def idx_term_lookup(spark, d):
    """The filter is on the tokens, before they are counted."""
    toks = doc_tokens(spark, d).where(F.col("term").isin("the", "of", "nicht", "quell", "absent-term"))
    return I.terms(I.postings(toks)).select("term", "df", "cf")
