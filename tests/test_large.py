"""What keeps the engine's steps in proportion to large tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import graph, index, ingest, search
from quarry.plans import catalogue, common
from quarry.sources import querylog, warc

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_terms_are_admitted_as_their_class_says(spark):
    terms = ["a", "ab", "�", "東京", "カ", "12345678901234567", "123", "aaaaaaaa", "xaaaaaaaab", "aaaaaaa", "ü" * 33, "ü" * 7, "abcdefghijklmnopqrstuvw1", "abcdefghijklmnopqrstuv1", "straßenname", "1234567890"]
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    got = rows.select("term", text.term_class(F.col("term")).alias("c"), text.is_admitted(F.col("term")).alias("ok")).collect()
    assert [r.ok for r in got] == [r.c in text.ADMITTED for r in got]
    assert {r.term for r in got if not r.ok} == {"�", "12345678901234567", "aaaaaaaa", "xaaaaaaaab", "ü" * 33, "abcdefghijklmnopqrstuvw1"}


def test_tokens_are_counted_where_their_texts_are(spark):
    """Texts are shuffled by docid, tokens and postings aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # of several tasks
    for counted in (index.postings(index.tokens(docs)), index.postings(index.tokens(docs), True)):
        assert "hashpartitioning" not in plan(counted) and "rangepartitioning(docid" in plan(counted)


def test_positions_across_batches():
    """a document's postings of a term may come in any number of batches."""
    rnd = random.Random(3)
    rows = sorted((f"t{rnd.randrange(4)}", rnd.randrange(3), rnd.randrange(2), rnd.choice([rnd.randrange(50), 70_000, 80_000])) for _ in range(300))
    n, key, table = 0, None, []
    for r in rows:
        n, key = (n + 1, key) if r[:2] == key else (1, r[:2])
        table.append((*r, n))
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table[a : a + size], strict=True), kinds, strict=True)], ["term", "docid", "field", "pos", "n"]) for a in range(0, len(table), size)]
        got = [tuple(r.values()) for b in index.gathered(iter(batches)) for r in b.to_pylist()]
        want = []
        for k in sorted({r[:2] for r in rows}):
            own = [r for r in rows if r[:2] == k]
            lists = [sorted({min(r[3], 65535) for r in own if r[2] == f}) for f in (0, 1)]
            want.append((*k, len(own), sum({1 << r[2] for r in own}), sum(r[2] == 0 for r in own), *lists))
        assert got == want


def test_blocks_and_gaps_over_chunks(spark):
    """Postings travel packed, one row for a term and chunk, and blocks and gaps go on over chunks."""
    rnd = random.Random(4)
    held = {"all": sorted(rnd.sample(range(5 * index.CHUNK), 700)), "two": [3, 4 * index.CHUNK], "five": [0, 1, 2, index.CHUNK - 1, index.CHUNK]}
    rows = [(t, d, 1 + d % 255) for t, ds in held.items() for d in ds]
    posts = spark.createDataFrame(rows, "term string, docid bigint, impact int").repartition(3)
    want = {(t, i // 128, ds[i], ds[min(i + 127, len(ds) - 1)], len(ds[i : i + 128]), max(1 + d % 255 for d in ds[i : i + 128])) for t, ds in held.items() if len(ds) > 4 for i in range(0, len(ds), 128)}
    assert {tuple(r) for r in index.blocks(posts).collect()} == want
    gaps = index.gaps(posts).collect()
    assert sorted(tuple(r) for r in gaps) == sorted((t, d, d - (ds[i - 1] if i else 0)) for t, ds in held.items() for i, d in enumerate(ds))
    assert index.packs(posts).count() == len({(t, d >> index.CHUNK_BITS) for t, d, _ in rows})


def test_only_the_tables_asked_for_are_stored(spark, monkeypatch):
    """a search that reads postings alone writes neither blocks nor snippets."""
    monkeypatch.setattr(common, "_INDEXES", {})
    asked = []
    monkeypatch.setattr(index, "write_index", lambda docs, path, tables=index.TABLES, f=index.write_index: (asked.extend(tables), f(docs, path, tables=tables)))
    catalogue.queries()["search_topk_3terms"](spark, SF).collect()
    assert asked == ["postings"]
    catalogue.queries()["search_blockmax"](spark, SF).collect()
    assert asked == ["postings", "blocks"]


def test_batch_of_queries_as_one_by_one(spark):
    """the scores of a batch are matrices, with the ranks of search(), ties and repeated terms too."""
    rnd = random.Random(6)
    rows = [(f"t{t}", d, rnd.choice([1, 1, 2, 3, 400])) for t in range(12) for d in rnd.sample(range(3000), [2500, 1500, 900, 300, 40, 5, 4, 3, 2, 1, 1, 700][t])]
    posts = spark.createDataFrame(rows, "term string, docid bigint, tf int").repartition(5)
    asked = {q: [f"t{rnd.randrange(13)}" for _ in range(rnd.randint(1, 6))] + ([("t0", search.NOT)] if q == 3 else []) for q in range(7)} | {90: ["absent"]}
    q = search.query_rows(spark, asked)
    got, want = search.search_batch(posts, q, 20), search.search(posts, q, 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    floor = np.zeros(2, np.int64)
    best = search.kept_best(np.array([[0, 0, 0, 1], [9, 4, 7, 1], [5, 5, 6, 2]]), 2, floor)
    assert best.tolist() == [[0, 0, 1], [7, 4, 1], [6, 5, 2]] and floor.tolist() == [5, 0]


def test_texts_of_hits_are_not_shuffled(spark):
    """the hits go to the texts."""
    hits = spark.range(5).select(F.lit(0).alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("docid"), F.lit(2).alias("score")).distinct()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("docid"), "text", "lang")
    for shown in (search.with_snippets(hits, docs), search.displayed(hits, docs)):
        assert "BroadcastHashJoin" in plan(shown) and "hashpartitioning(docid" not in plan(shown)
        assert shown.count() == 5


@pytest.mark.parametrize("at_once", [1, 1 << 18])
def test_near_pairs_count_once(spark, monkeypatch, at_once):
    """56 tables of interleaved bits; each pair is in one of them alone, without a distinct."""
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    rnd = random.Random(8)
    hashes = {rnd.getrandbits(64) for _ in range(40)}
    for h in list(hashes):
        for _ in range(8):
            hashes.add(h ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(1, 4))}))
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    want = sorted((a, b, n) for a in signed for b in signed if a < b and (n := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 3)
    got = graph.near_pairs(spark.createDataFrame([(h,) for h in signed], "simhash bigint"))
    assert sorted((r.a, r.b, r.distance) for r in got.collect()) == want
    assert len(graph.TABLES) == 56 and all(bin(m).count("1") == 40 for m in graph.TABLES.values())
    assert "Join" not in plan(got)


def test_terms_are_counted_once(spark):
    """what is made of the terms reads the texts once."""
    posts = index.postings(index.tokens(spark.read.parquet(f"{SF}/documents.parquet")))
    assert "posexplode" not in plan(querylog.bands(index.terms(posts)))
    assert plan(catalogue.queries()["residency"](spark, SF)).count("FileScan") == 1


def test_segments_without_texts(spark):
    """texts don't go to a partition's one task; rows of a null or repeated place stay."""
    rows = spark.createDataFrame([(p, a, "x" * (10 * n), "u") for p in (0, 1) for n, a in enumerate([None, 1, 2, 2, 2, 3, 4])], "partition int, arrival bigint, text string, url string")
    got = ingest.sealed_by_size(rows, max_rows=3, max_bytes=1 << 20).select("partition", "arrival", "text", "seq").collect()
    assert sorted((r.partition, r.arrival or 0, len(r.text), r.seq) for r in got) == sorted((p, a or 0, 10 * n, n // 3 + 1) for p in (0, 1) for n, a in enumerate([None, 1, 2, 2, 2, 3, 4]))
    by_bytes = plan(catalogue.queries()["segments_by_bytes"](spark, SF))
    assert "text" not in by_bytes[by_bytes.index("Sort [") : by_bytes.index("Exchange")]


@pytest.mark.parametrize("most", [1, 2000, 1 << 30])
def test_files_go_on_in_parts(monkeypatch, most):
    """what Python holds doesn't grow with Arrow's batches."""
    monkeypatch.setattr(warc, "PART_BYTES", most)
    rows = [(f"f{i // 3}", i, "conversion", f"http://a.test/{i}", "", f"text {i} " * 100) for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "at", "type", "url", "date", "text"])
    files = list(warc.pack(iter([batch])))
    records = list(warc.parse(iter(files)))
    assert (len(files), len(records)) == {1: (4, 12), 2000: (len(files), 4), 1 << 30: (1, 1)}[most]
    assert [(r["file"], r["url"], r["text"]) for b in records for r in b.to_pylist()] == [(r[0], r[3], r[5]) for r in rows]
