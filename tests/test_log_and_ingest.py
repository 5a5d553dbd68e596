from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import fold, graph, ingest, ordered
from quarry.sources import fixture, querylog, warc
from quarry.streaming import fold as stream

LOG = "seq bigint, ord int, kind string, unit bigint, node bigint, epoch bigint, deadline_ms bigint"


def test_zombie_fence(spark):
    rows = [(0, 0, "lease_grant", 7, 1, 4, 60_000), (1, 0, "lease_grant", 7, 2, 5, 150_000), (1, 1, "seg_commit", 7, 2, 5, 0), (2, 0, "seg_commit", 7, 1, 4, 0)]
    log = spark.createDataFrame(rows, LOG)
    held = fold.tenures(log, ("unit",))
    commits = log.where("kind = 'seg_commit'").select("seq", "ord", "unit", "epoch", F.col("node").alias("writer"))
    got = {(r.writer, r.epoch): r.accepted for r in fold.fenced(commits, held, ("unit",)).collect()}
    assert got == {(2, 5): True, (1, 4): False}
    units = spark.createDataFrame([(7,), (8,)], "unit bigint")
    before = fold.leases(fold.tenures(log.where("seq = 0"), ("unit",)), ("unit",))
    claim = {r.unit: r.claim_epoch for r in fold.claimable(before, units, F.lit(90_000), ("unit",)).collect()}
    assert claim == {7: 5, 8: 1}
    assert before.where(fold.must_suspend(F.lit(90_000))).count() == 1


def _replay(rows):
    """Leases and accepted commits, record by record."""
    state, ok = {}, []
    for seq, _, kind, unit, node, epoch, deadline in rows:
        e, n, d, rel = state.get(unit, (0, -1, 0, False))
        if kind == "lease_grant":
            if epoch > e:
                state[unit] = (epoch, node, deadline, False)
            elif epoch == e and node == n and not rel:
                state[unit] = (e, n, max(d, deadline), rel)
        elif kind == "lease_release" and epoch == e and n >= 0:
            state[unit] = (e, n, d, True)
        elif kind == "seg_commit" and epoch == e and node == n and not rel:
            ok.append(seq)
    return state, ok


def _random_log(seed, n=400):
    rnd = random.Random(seed)
    top, rows = [0] * 4, []
    for seq in range(n):
        unit, kind = rnd.randrange(4), rnd.choice(["lease_grant", "lease_grant", "lease_release", "seg_commit", "seg_commit"])
        epoch = max(0, top[unit] + rnd.choice([-2, -1, 0, 0, 0, 1]) if kind == "lease_grant" else top[unit] - rnd.choice([0, 0, 1]))
        if kind == "lease_grant":
            epoch = max(1, epoch)
            top[unit] = max(top[unit], epoch)
        rows.append((seq, 0, kind, unit, rnd.randrange(3), epoch, rnd.randrange(10_000)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lease_torture(spark, seed):
    rows = _random_log(seed)
    state, ok = _replay(rows)
    log = spark.createDataFrame(rows, LOG)
    held = fold.tenures(log, ("unit",)).cache()
    got = {r.unit: (r.epoch, r.node, r.deadline_ms, r.released) for r in fold.leases(held, ("unit",)).collect()}
    assert got == {u: s for u, s in state.items() if s[1] >= 0}
    commits = log.where("kind = 'seg_commit'").select("seq", "ord", "unit", "epoch", F.col("node").alias("writer"))
    assert sorted(r.seq for r in fold.fenced(commits, held, ("unit",)).where("accepted").collect()) == ok


def test_lease_stream_equals_batch(spark, tmp_path):
    rows = _random_log(9, 200)
    log = spark.createDataFrame(rows, LOG)
    for k in range(4):
        log.where(F.floor(F.col("seq") % 200 / 50) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    tailed = stream.tail(spark, str(tmp_path / "log"), log.schema, 1)
    stream.run_to_end(stream.lease_stream(tailed), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    # A second run goes on from the checkpoint and finds only what is new.
    more = [(200, 0, "lease_grant", 0, 1, 99, 5)]
    spark.createDataFrame(more, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream.run_to_end(stream.lease_stream(stream.tail(spark, str(tmp_path / "log"), log.schema, 1)), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("unit").agg(F.max_by(F.struct("epoch", "node", "deadline_ms", "released"), "seq").alias("s"))
    assert {r.unit: tuple(r.s) for r in last.collect()} == _replay(rows + more)[0]


def test_manifest_zombie(spark):
    man = spark.createDataFrame([(42, 3, 5, 500), (42, 1, 5, 150), (42, 4, 6, 600), (42, 2, 5, 400), (43, 1, 9, 10)], "partition bigint, man_seq bigint, epoch bigint, watermark bigint")
    held = spark.createDataFrame([(42, 5, 400), (42, 6, 460)], "partition bigint, epoch bigint, held bigint")
    # Epoch 5 is held up to 400: the third manifest's bar is the second one's 400, so it is valid; cut one earlier it is a zombie.
    assert [(r.partition, r.man_seq) for r in fold.select_manifests(man, held.where("epoch = 6").unionAll(spark.createDataFrame([(42, 5, 200)], held.schema))).collect()] == [(42, 4)]
    assert fold.select_manifests(man.where("partition = 43"), held).count() == 0


def test_set_folds(spark):
    log = spark.createDataFrame([(0, 0, "gen_publish", 1, 1, "base"), (1, 0, "gen_publish", 1, 2, "delta"), (2, 0, "gen_retire", 1, 1, None), (2, 1, "gen_publish", 2, 1, "base")], "seq bigint, ord int, kind string, shard bigint, generation bigint, gen_kind string")
    assert {(r.shard, r.generation) for r in fold.generations(log).collect()} == {(1, 2), (2, 1)}
    tier = spark.createDataFrame([(0, 0, "tier_map", 2, [(1, 1)]), (1, 0, "tier_map", 3, [(1, 2), (2, 0)]), (2, 0, "tier_map", 3, [(9, 9)])], "seq bigint, ord int, kind string, version bigint, assign array<struct<shard: bigint, tier: bigint>>")
    assert {(r.shard, r.tier) for r in fold.tiers(tier).collect()} == {(1, 2), (2, 0)}


def test_warc_import(spark, tmp_path):
    body = "a text of more than sixty-four bytes, so that the importer doesn't drop it as short"
    rows = [{"type": "warcinfo", "url": "", "text": "x"}]
    rows += [{"type": "conversion", "url": u, "date": "2024-01-02T03:04:05Z", "text": t} for u, t in (("https://a.test/1?utm_source=z", body), ("https://a.test/1", body), ("ftp://a.test/2", body), ("https://a.test/3", "short"), ("https://A.test/4", body + "!"))]
    warc.write_warc(rows, str(tmp_path / "one.warc.gz"))
    got = warc.read_warc(spark, str(tmp_path)).cache()
    assert got.count() == 6
    pages = ingest.import_records(got)
    assert sorted(r.url for r in pages.collect()) == ["https://a.test/1", "https://a.test/4"]
    assert {r.fetch_ms for r in pages.collect()} == {1704164645000}
    with pytest.raises(ValueError):
        list(warc.records(__import__("io").BytesIO(b"no record\r\n")))


def test_import_of_many_files(spark, tmp_path):
    """Places begin anew in each file; the order is the file, then the place. Of equal pages the first stays, wherever the others are."""
    body = lambda i: f"page number {i} with a text that is long enough for the importer to keep it as it is"
    one = [("conversion", f"https://b.test/{i}", body(i)) for i in range(6)]
    two = [("warcinfo", "", "x"), *[("conversion", f"https://b.test/{i}?utm_source=again", body(i)) for i in range(6)], *[("conversion", f"https://b.test/{i}", body(i)) for i in range(6, 11)], ("conversion", "https://b.test/12", "short"), ("conversion", "gopher://b.test/", body(13))]
    for name, rows in (("b.warc.gz", two), ("a.warc.gz", one)):
        warc.write_warc([{"type": k, "url": u, "text": t} for k, u, t in rows], str(tmp_path / name))
    records = warc.read_warc(spark, str(tmp_path)).cache()
    pages = ingest.docids(ingest.import_records(records, 1, max_rows=4)).orderBy("docid").collect()
    assert [r.docid for r in pages] == list(range(11)) and [r.url for r in pages] == [f"https://b.test/{i}" for i in range(11)]
    assert [r.seq for r in pages] == [1] * 4 + [2] * 4 + [3] * 3
    assert ingest.import_statistics(records, 1, max_rows=4).first().asDict() == {"pages": 11, "dups": 6, "rejected": 1, "short": 1, "segments": 3}
    none = ingest.import_statistics(records.where("false")).first()
    assert (none.pages, none.dups, none.segments) == (0, 0, 0)


def test_first_wins_with_null_keys(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "k", None), (4, "k", "x")], "arrival bigint, a string, b string")
    assert {r.arrival: r.dup for r in ingest.first_wins(rows, ["a", "b"]).collect()} == {1: False, 2: True, 3: False, 4: False}
    assert {r.arrival for r in ingest.firsts(rows, ["a", "b"]).collect()} == {1, 3, 4}


def test_numbered_and_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), (F.col("id") % 13).alias("v")).repartition(5)
    got = ordered.numbered(rows, [F.desc("x")], "place", ("v", "sum")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and [r.x for r in got] == sorted((r.x for r in got), reverse=True)
    total = 0
    for r in got:
        total += r.v
        assert r.sum == total
    assert ordered.numbered(rows.where("false"), ["x"]).count() == 0


def test_segment_commits(spark, tmp_path):
    rows = spark.createDataFrame([(0, i, "u", "x" * 50) for i in range(10)], "partition int, arrival bigint, url string, text string")
    seqs = {r.arrival: r.seq for r in ingest.sealed_by_size(rows, max_rows=100, max_bytes=3 * 131).collect()}
    assert [seqs[i] for i in range(10)] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
    pages = spark.createDataFrame([(0, 5), (0, 3), (1, 4)], "partition int, fetch_ms bigint")
    pages = pages.withColumn("urlfp", F.encode(F.lit("f"), "UTF-8"))
    ingest.commit(spark, pages, str(tmp_path / "p"), str(tmp_path / "l"), 1, 1, 1)
    ingest.write_pages(pages.withColumn("seg_seq", F.lit(2).cast("bigint")), str(tmp_path / "p"))
    both = spark.read.parquet(str(tmp_path / "p"))
    assert both.count() == 6 and ingest.visible(both, spark.read.parquet(str(tmp_path / "l"))).count() == 3


def test_near_pairs_are_all_found(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(20)]
    hashes = base + [b ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)) for b in base for _ in range(3)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "docid bigint, simhash bigint")
    got = {(r.a, r.b) for r in graph.near_pairs(df).collect()}
    assert got == {(a, b) for a in set(hashes) for b in set(hashes) if a < b and bin(a ^ b).count("1") <= 3}


def test_query_log(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# comment\n\none  two\n three\n")
    assert [r.terms for r in querylog.read_query_log(spark, str(tmp_path / "q.txt")).collect()] == [["one", "two"], ["three"]]
    terms = spark.createDataFrame([(f"t{i:03}", 1000 - i) for i in range(300)], "term string, df bigint")
    got = querylog.synthesize(terms, 300).collect()
    assert len(got) == 300 and all(1 <= len(r.terms) <= 5 and len(set(r.terms)) == len(r.terms) for r in got)
    head = sum(t in ("t000", "t001", "t002") for r in got for t in r.terms) / sum(len(r.terms) for r in got)
    assert 0.35 < head < 0.7


def test_fixture_is_a_function(spark):
    one, two = fixture.corpus(spark, 300), fixture.corpus(spark, 300).repartition(7)
    assert fixture.digest(one).first() == fixture.digest(two).first()
    stats = one.agg(F.count_if(F.col("template").isNotNull()).alias("t"), F.min("out_degree").alias("low"), F.max("out_degree").alias("high")).first()
    assert 10 <= stats.t <= 60 and stats.low >= 4 and stats.high <= 300
