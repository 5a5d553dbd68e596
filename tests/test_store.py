from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import store
from quarry.sources import html
from quarry.streaming import fold as stream


def test_manifest_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 20, 6)], "partition bigint, seg_seq bigint, rows bigint, watermark bigint")
    store.write_manifest(rows, str(tmp_path / "m"), 1)
    store.write_manifest(rows.where("seg_seq = 2"), str(tmp_path / "m"), 2)
    assert [r.seg_seq for r in store.live_segments(spark.read.parquet(str(tmp_path / "m"))).collect()] == [2]
    with pytest.raises(ValueError):
        store.write_manifest(rows, str(tmp_path / "m"), 2)


def test_frontier_sections(spark, tmp_path):
    rows = spark.range(130).select((F.col("id") % 65).cast("int").alias("section_id"), F.lit("u").alias("urlfp"), F.col("id").alias("due_ms"), F.lit(0).alias("priority"))
    with pytest.raises(ValueError):
        store.write_frontier(rows, str(tmp_path / "no"))
    store.write_frontier(rows.where("section_id < 64"), str(tmp_path / "f"))
    one = store.section(spark.read.parquet(str(tmp_path / "f")), 7)
    assert sorted(r.due_ms for r in one.collect()) == [7, 72]
    assert "PartitionFilters: [isnotnull(section_id" in one._jdf.queryExecution().executedPlan().toString()


def test_docmap_lookup_and_generations(spark, tmp_path):
    schema = "urlfp binary, docid bigint, canon_fp binary, flags int"
    old = spark.createDataFrame([(b"a", 2, None, 0), (b"a", 1, None, 0), (b"b", 3, None, 0)], schema)
    new = spark.createDataFrame([(b"b", 9, b"a", 1), (b"c", 8, None, 0)], schema)
    for name, rows in (("old", old), ("new", new)):
        store.write_docmap(rows, str(tmp_path / name))
    read = [spark.read.parquet(str(tmp_path / n)) for n in ("old", "new")]
    assert [(bytes(r.urlfp), r.docid) for r in store.find(read[0], [b"a", b"z"]).collect()] == [(b"a", 1)]
    got = {bytes(r.urlfp): (r.docid, r.flags) for r in store.merged_docmap(read).collect()}
    assert got == {b"a": (1, 0), b"b": (9, 1), b"c": (8, 0)}


def test_tombstones_wait_for_the_latest(spark, tmp_path):
    schema = "key string, reason int, eligible_ms bigint"
    store.write_tombstones(spark.createDataFrame([("x", 1, 10), ("y", 1, 10)], schema), str(tmp_path / "t"))
    store.write_tombstones(spark.createDataFrame([("x", 2, 50)], schema), str(tmp_path / "t"))
    pages = spark.read.parquet(str(tmp_path / "t"))
    assert {r.key for r in store.collectable(pages, F.lit(20)).collect()} == {"y"}
    assert {(r.key, r.reason) for r in store.collectable(pages, F.lit(50)).collect()} == {("x", 2), ("y", 1)}


def _lines(n, seed):
    rnd = random.Random(seed)
    for seq in range(n):
        kind = rnd.choice(["member", "man_advance", "gen_publish", "gen_retire", "seg_commit", "lease_grant", "other"])
        yield {"seq": seq, "ord": rnd.randrange(2), "kind": kind, "node": rnd.randrange(3), "endpoint": f"e{rnd.randrange(9)}", "version": seq, "family": rnd.randrange(2), "partition": rnd.randrange(3), "man_seq": rnd.randrange(99), "shard": rnd.randrange(2), "generation": rnd.randrange(3), "gen_kind": "base", "watermark": rnd.randrange(99)}


@pytest.mark.parametrize("seed", [1, 2])
def test_boot_is_the_full_fold(spark, tmp_path, seed):
    """For every kind; a second flush finds the first one's snapshot; before the first boundary there is none."""
    records = store.with_table(store.decoded(spark.createDataFrame([(json.dumps(r),) for r in _lines(90, seed)] + [("{broken",)], "json string"))).cache()
    assert records.where("kind = 'other'").count() == 0
    path = str(tmp_path / "ckpt")
    at = store.flush(records, path, 32)
    assert at == 63 and store.flush(records, path, 32) == 63
    row = lambda df: sorted(map(tuple, df.collect()))
    assert row(store.boot(records, path, at)) == row(store.snapshot(records))
    last = {}
    for r in sorted(_lines(90, seed), key=lambda r: (r["seq"], r["ord"])):
        if r["kind"] == "man_advance":
            last[r["family"], r["partition"]] = r["man_seq"]
    got = {tuple(json.loads(r.key).values()): json.loads(r.value)["man_seq"] for r in store.snapshot(records).where("table = 'manifest'").collect()}
    assert got == last
    assert store.flush(records.where("seq < 30"), path, 32) is None
    assert row(store.boot(records.where("seq < 30"), path, None)) == row(store.snapshot(records.where("seq < 30")))


def test_wat_flags(spark):
    links = [{"path": "A@/href", "url": "u1", "text": "t", "rel": "nofollow ugc"}, {"path": "IMG@/src", "url": "i"}, {"path": "A@/href", "url": "u2", "rel": "sponsored"}, {"path": "A@/href", "url": "u3"}]
    doc = json.dumps({"Envelope": {"Payload-Metadata": {"HTTP-Response-Metadata": {"HTML-Metadata": {"Links": links}}}}})
    got = html.wat_links(spark.createDataFrame([(1, doc), (2, "{}")], "id int, json string")).orderBy("pos").collect()
    assert [(r.id, r.href, r.flags) for r in got] == [(1, "u1", 3), (1, "u2", 4), (1, "u3", 0)]


def test_windows_and_sessions(spark, tmp_path):
    rows = [(1, "a", 0), (1, "a", 100), (1, "b", 4000), (2, "a", 50), (9, "z", 90_000)]
    spark.createDataFrame(rows, "user_id bigint, event_type string, s bigint").coalesce(1).write.parquet(str(tmp_path / "log"))
    tailed = stream.tail(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema, 1).withColumn("ts", F.timestamp_seconds("s"))
    stream.run_to_end(stream.windowed_counts(tailed), str(tmp_path / "w"), str(tmp_path / "ws"), "append")
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "w")).select(F.unix_seconds("window.start").alias("start"), "event_type", "n").collect()}
    assert got == {(0, "a"): 3, (3600, "b"): 1}
    stream.run_to_end(stream.sessions(tailed), str(tmp_path / "s"), str(tmp_path / "ss"), "append")
    assert sorted((r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, 1), (1, 2), (2, 1)]
