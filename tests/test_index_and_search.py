from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, index, search

#: Title and text; no word but "rose" is in more than four texts.
PAGES = [
    ("Rose hedge", "a hedge of rose and thorn stands along our lane"),
    ("Compost", "turn the compost twice and let it rest"),
    ("Rose care", "cut each rose in march so that the rose can breathe, then feed every rose"),
    ("Pond", "frogs like a shallow pond with reeds"),
    ("Wall", "against this wall a climbing rose needs wire"),
    ("Shed", "tools hang in the shed beside twine and wire"),
]


@pytest.fixture(scope="module")
def garden(spark):
    return spark.createDataFrame([(i, t, x, f"https://garden.test/{i}") for i, (t, x) in enumerate(PAGES)], "doc_id bigint, title string, text string, url string")


def test_two_fields_are_scored(spark, garden):
    posts = index.postings(index.tokens(garden, "doc_id", "text", "title"))
    hits = search.search(posts, search.query_rows(spark, {0: ["rose", "wire"]}), 4).orderBy("rank").collect()
    words = lambda i: " ".join(PAGES[i]).lower().replace(",", "").split()
    score = {i: sum(w in ("rose", "wire") for w in words(i)) for i in range(len(PAGES))}
    assert [(h.docid, h.score) for h in hits] == sorted(((i, n) for i, n in score.items() if n), key=lambda x: (-x[1], x[0]))[:4]


def test_index_on_disk(spark, garden, tmp_path):
    index.write_index(garden, str(tmp_path), shard=3, generation=2, title="title", url="url")
    posts = index.load(spark, str(tmp_path), "postings", 2)
    assert {r.shard for r in posts.select("shard").distinct().collect()} == {3}
    rose = posts.where("term = 'rose' AND docid = 2").first()
    assert (rose.tf, rose["mask"], rose.body_pos, rose.title_pos, rose.body_n) == (4, 3, [2, 8, 14], [0], 3)
    terms = {r.term: r for r in index.load(spark, str(tmp_path), "terms").collect()}
    assert (terms["rose"].df, terms["rose"].cf, terms["rose"].inlined) == (3, 7, True)
    values = {r.docid: r for r in index.load(spark, str(tmp_path), "docvalues").collect()}
    assert (values[3].doclen_body, values[3].doclen_title) == (3, 1)
    plan = index.load(spark, str(tmp_path), "postings").where("term = 'rose'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,rose)" in plan
    with pytest.raises(ValueError):
        index.write_index(garden.where("false"), str(tmp_path / "none"))


def test_caps_and_invariants(spark):
    docs = spark.createDataFrame([(i, "water " * (1 + i % 3) + ("zebra " * 300 if i == 7 else "")) for i in range(300)], "doc_id bigint, text string")
    posts = index.postings(index.tokens(docs), True).cache()
    zebra = posts.where("term = 'zebra'").first()
    assert (zebra.tf, zebra.impact) == (300, 255)
    assert posts.where("tf < 1 OR mask NOT BETWEEN 1 AND 3 OR size(body_pos) > tf").count() == 0
    blocks = index.blocks(posts).orderBy("block_id").collect()
    assert [(b.block_id, b.first_docid, b.last_docid, b.n, b.max_impact) for b in blocks] == [(0, 0, 127, 128, 3), (1, 128, 255, 128, 3), (2, 256, 299, 44, 3)]
    assert index.gaps(posts.where("term = 'water'")).where("docid > 0").agg(F.max("gap")).first()[0] == 1
    values = index.doc_values(docs, index.tokens(docs))
    assert values.where("docid = 7").first().doclen_body == 9


def test_position_sentinel(spark):
    docs = spark.createDataFrame([(0, "pad " * 70_000 + "omega")], "doc_id bigint, text string")
    posts = index.postings(index.tokens(docs), True)
    assert posts.where("term = 'omega'").first().body_pos == [65535]
    pad = posts.where("term = 'pad'").first().body_pos
    assert len(pad) == 65536 and pad[-1] == 65535


def _brute(rows, terms, k, deleted=()):
    score = {}
    for term, docid, tf in rows:
        if docid not in deleted:
            score[docid] = score.get(docid, 0) + min(tf, 255) * terms.count(term)
    return sorted(((d, s) for d, s in score.items() if s), key=lambda x: (-x[1], x[0]))[:k]


def test_rank_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(f"t{t:02}", d, 1 + int(30 * rnd.random() ** 3)) for t in range(15) for d in rnd.sample(range(2000), [1500, 900, 400, 200, 90, 40, 20, 10, 5, 4, 3, 2, 1, 1, 600][t])]
    posts = spark.createDataFrame(rows, "term string, docid bigint, tf int").withColumn("impact", F.least("tf", F.lit(255))).cache()
    blocks = index.blocks(posts.withColumn("mask", F.lit(1))).cache()
    queries = {q: [f"t{rnd.randrange(15):02}" for _ in range(rnd.randint(1, 4))] for q in range(12)}
    q = search.query_rows(spark, queries)
    for k in (10, 100):
        flat = {r["query_id"]: [] for r in q.select("query_id").distinct().collect()}
        for r in search.search(posts, q, k).orderBy("query_id", "rank").collect():
            flat[r.query_id].append((r.docid, r.score))
        pruned = {i: [] for i in flat}
        for r in search.pruned_search(posts, blocks, q, k, span=256).orderBy("query_id", "rank").collect():
            pruned[r.query_id].append((r.docid, r.score))
        table = index.terms(posts).cache()
        by_max = {i: [] for i in flat}
        for r in search.maxscore_search(posts, table, q, k).orderBy("query_id", "rank").collect():
            by_max[r.query_id].append((r.docid, r.score))
        mixed = {i: [] for i in flat}
        for r in search.hybrid_search(posts, table, blocks, q, k).orderBy("query_id", "rank").collect():
            mixed[r.query_id].append((r.docid, r.score))
        for i, terms in queries.items():
            assert by_max[i] == mixed[i] == _brute(rows, terms, k)
            assert flat[i] == _brute(rows, terms, k)
            assert pruned[i] == flat[i]
    gone = spark.createDataFrame([(d,) for d in range(0, 2000, 3)], "docid bigint")
    got = search.search(posts, search.query_rows(spark, {0: ["t00", "t01"]}), 20, deleted=gone).orderBy("rank").collect()
    assert [(r.docid, r.score) for r in got] == _brute(rows, ["t00", "t01"], 20, set(range(0, 2000, 3)))


def test_records_in_order(spark, garden):
    docs = garden.select(F.col("doc_id").alias("docid"), "title")
    assert [r.title for r in search.records_in_order(docs, [3, 1, 3, 99]).orderBy("pos").collect()] == ["Pond", "Compost", "Pond"]
    with pytest.raises(ValueError):
        search.records_in_order(docs, [1] * 1025)


def test_validation_and_degrade(spark):
    with pytest.raises(ValueError):
        search.query_rows(spark, {0: ["a"] * 33})
    with pytest.raises(ValueError):
        search.search(spark.createDataFrame([], "term string, docid bigint, tf int"), search.query_rows(spark, {0: ["a"]}), 4097)
    for bad in ((["a"], 0, 1, [0]), (["a"], 2, 1, [0]), ([], 1, 1, [0]), (["a"] * 33, 1, 1, [0]), (["a" * 65], 1, 1, [0]), (["a"], 1, 1, [])):
        with pytest.raises(ValueError):
            search.validate(*bad)
    assert search.degrade_bits(spark, [0, 9], [0]) == 16 and search.degrade_bits(spark, [0], [0]) == 0


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    c.create(shards=4)
    with pytest.raises(ValueError):
        c.create()
    assert c.advance(10) and not c.advance(5) and c.root()["ckpt_seq"] == 10
    c.record("publish", 0, 1)
    c.record("publish", 0, 2, 1)
    pinned = c.pin()
    c.record("retire", 0, 2)
    assert pinned == {0: 2} and c.pin() == {0: 1}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "docid bigint, x string")
    dead = spark.createDataFrame([(2, 2)], "docid bigint, base_docs bigint")
    out = catalog.overlay(base, spark.createDataFrame([(9, "n")], base.schema), catalog.exclusions(dead, 2))
    assert {r.docid for r in out.collect()} == {1, 9}
    with pytest.raises(ValueError):
        catalog.exclusions(dead, 3)
