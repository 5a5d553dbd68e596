"""Queries of the coordination log, its stream, replay reports and the synthetic corpus. The log is derived from events by one rule in both dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.hashing import object_key
from quarry.operators import fold as L
from quarry.operators import index as I
from quarry.operators import replay as R
from quarry.operators import store as C
from quarry.operators.ingest import visible
from quarry.plans.common import TERMS_SQL, doc_postings, table
from quarry.plans.registry import query
from quarry.schemas import GC_TOMBSTONE, LEDGER
from quarry.sources import fixture
from quarry.sources.querylog import bands, synthesize
from quarry.sources.stored import scratch

NOW = 9_000_000

#: {k}: how the dialect reads k of props.
_LOG = """SELECT *, CASE WHEN grants = 0 THEN 0 WHEN kind = 'lease_grant' OR k % 4 > 0 THEN (grants - 1) DIV_ 3 + 1 ELSE (grants - 1) DIV_ 3 END AS epoch FROM (
SELECT *, sum(CASE WHEN kind = 'lease_grant' THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grants FROM (
SELECT event_id AS seq, 0 AS ord, user_id % 16 AS unit, user_id % 5 AS node, ts, value, CAST({k} AS BIGINT) AS k, event_id * 1000 + CAST(floor(value * 1000) AS BIGINT) AS deadline_ms,
  CASE event_type WHEN 'signup' THEN 'lease_grant' WHEN 'error' THEN 'lease_release' WHEN 'purchase' THEN 'seg_commit' WHEN 'view' THEN 'man_advance' ELSE 'ckpt' END AS kind FROM events) a) b"""
LOG_SQL = "log AS (" + _LOG.replace("DIV_", "//").format(k="json_extract_string(props, '$.k')") + ")"
STATE_SQL = (
    LOG_SQL
    + """,
ev AS (SELECT unit, seq, row_number() OVER (PARTITION BY unit ORDER BY seq) AS rn, kind, epoch, node, deadline_ms FROM log WHERE kind IN ('lease_grant', 'lease_release')),
st AS (SELECT DISTINCT unit, 0::BIGINT AS rn, -1::BIGINT AS seq, 0::BIGINT AS epoch, -1::BIGINT AS node, 0::BIGINT AS deadline_ms, false AS released FROM ev
  UNION ALL SELECT s.unit, e.rn, e.seq, CASE WHEN g AND e.epoch > s.epoch THEN e.epoch ELSE s.epoch END, CASE WHEN g AND e.epoch > s.epoch THEN e.node ELSE s.node END,
    CASE WHEN g AND e.epoch > s.epoch THEN e.deadline_ms WHEN g AND e.epoch = s.epoch AND e.node = s.node AND NOT s.released THEN greatest(s.deadline_ms, e.deadline_ms) ELSE s.deadline_ms END,
    CASE WHEN g AND e.epoch > s.epoch THEN false WHEN NOT g AND e.epoch = s.epoch THEN true ELSE s.released END
  FROM st s JOIN (SELECT *, kind = 'lease_grant' AS g FROM ev) e ON e.unit = s.unit AND e.rn = s.rn + 1),
fin AS (SELECT unit, epoch, node, deadline_ms, released FROM st QUALIFY row_number() OVER (PARTITION BY unit ORDER BY rn DESC) = 1)"""
)


def log(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_log_events")
    text = _LOG.replace("FROM events", "FROM _log_events").replace("DIV_", "DIV").format(k="get_json_object(props, '$.k')")
    return spark.sql(text).withColumn("epoch", F.col("epoch").cast("bigint"))


def _tenures(spark, d):
    return L.tenures(log(spark, d), ("unit",))


@query("log_members", f"WITH {LOG_SQL} SELECT node, max(seq) AS version, arg_max(k, seq) AS endpoint FROM log WHERE kind = 'lease_grant' GROUP BY node")
def log_members(spark, d):
    rows = log(spark, d).where("kind = 'lease_grant'").withColumn("kind", F.lit("member"))
    return L.newest(rows.select("kind", "seq", "ord", "node", F.col("seq").alias("version"), F.col("k").alias("endpoint")), "member", ["node"], ["version", "endpoint"])


@query("log_manifests", f"WITH {LOG_SQL} SELECT k % 2 AS family, unit AS partition, max(seq) AS man_seq FROM log WHERE kind = 'man_advance' GROUP BY ALL")
def log_manifests(spark, d):
    return L.manifests(log(spark, d).select("kind", (F.col("k") % 2).alias("family"), F.col("unit").alias("partition"), F.col("seq").alias("man_seq")))


@query(
    "log_gens",
    f"WITH {LOG_SQL}, g AS (SELECT unit AS shard, k % 8 AS generation, arg_max(k % 3, seq) AS last FROM log WHERE kind = 'seg_commit' GROUP BY ALL) SELECT shard, generation, last AS gen_kind FROM g WHERE last > 0",
)
def log_gens(spark, d):
    rows = log(spark, d).where("kind = 'seg_commit'")
    rows = rows.select(F.when(F.col("k") % 3 > 0, "gen_publish").otherwise("gen_retire").alias("kind"), "seq", "ord", F.col("unit").alias("shard"), (F.col("k") % 8).alias("generation"), (F.col("k") % 3).alias("gen_kind"))
    return L.generations(rows)


@query("log_tiers", f"WITH {LOG_SQL}, b AS (SELECT k AS version, unit, node FROM log WHERE kind = 'ckpt' ORDER BY k DESC, seq LIMIT 1) SELECT version, unit AS shard, node % 3 AS tier FROM b UNION ALL SELECT version, unit + 1, (node + 1) % 3 FROM b")
def log_tiers(spark, d):
    assign = F.expr("array(struct(unit AS shard, node % 3 AS tier), struct(unit + 1 AS shard, (node + 1) % 3 AS tier))")
    return L.tiers(log(spark, d).where("kind = 'ckpt'").select(F.lit("tier_map").alias("kind"), "seq", "ord", F.col("k").alias("version"), assign.alias("assign")))


@query("log_ckpt", f"WITH {LOG_SQL} SELECT max(seq) AS ckpt_seq FROM log WHERE kind = 'ckpt'")
def log_ckpt(spark, d):
    return L.checkpoint(log(spark, d).withColumn("ckpt_seq", F.col("seq")))


@query("log_boundaries", f"WITH {LOG_SQL} SELECT seq FROM log WHERE (seq + 1) % 4096 = 0")
def log_boundaries(spark, d):
    return L.boundaries(log(spark, d))


#: Records as JSON lines, one for each event and its kind; DuckDB reads the same fields from the log itself.
def _records(spark, d):
    rows = log(spark, d)
    kind = F.when(F.col("kind") == "lease_grant", "member").when(F.col("kind") == "ckpt", F.when(F.col("k") % 3 > 0, "gen_publish").otherwise("gen_retire")).otherwise(F.col("kind"))
    fields = {"seq": "seq", "ord": "ord", "kind": kind, "node": "node", "unit": "unit", "partition": "unit", "family": F.col("k") % 2, "man_seq": "seq", "shard": "unit", "generation": F.col("k") % 8, "gen_kind": (F.col("k") % 3).cast("string"), "watermark": F.col("seq") + F.col("k"), "endpoint": F.col("k").cast("string"), "version": "seq"}
    lines = rows.select(F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in fields.items()])).alias("json"))
    return C.with_table(C.decoded(lines.unionAll(spark.createDataFrame([("no record",), ('{"kind": "other", "seq": 1}',), ("{}",)], "json string"))))


_KINDS_SQL = f"""{LOG_SQL}, rec AS (SELECT *, k % 2 AS family, k % 8 AS generation, (k % 3)::VARCHAR AS gen_kind, seq + k AS watermark, CASE WHEN kind = 'lease_grant' THEN 'member' WHEN kind = 'ckpt' THEN CASE WHEN k % 3 > 0 THEN 'gen_publish' ELSE 'gen_retire' END ELSE kind END AS rkind FROM log),
kinds AS (SELECT 'member' AS "table", node::VARCHAR AS key, k::VARCHAR || '/' || seq AS value, seq FROM rec WHERE rkind = 'member'
  UNION ALL SELECT 'manifest', family || '/' || unit, seq::VARCHAR, seq FROM rec WHERE rkind = 'man_advance'
  UNION ALL SELECT 'generation', unit || '/' || generation, rkind || '/' || gen_kind, seq FROM rec WHERE rkind LIKE 'gen%'
  UNION ALL SELECT 'commit', unit::VARCHAR, watermark::VARCHAR, seq FROM rec WHERE rkind = 'seg_commit'),
folded AS (SELECT "table", key, arg_max(value, seq) AS value, max(seq) AS seq FROM kinds GROUP BY ALL)"""


def _shown(state):
    """The values of the JSON keys and values, one after another."""
    text = lambda c: F.array_join(F.map_values(F.from_json(c, "map<string, string>")), "/")
    return state.select("table", text("key").alias("key"), text("value").alias("value"), "seq")


@query("log_decode", f"WITH {_KINDS_SQL} SELECT rkind AS kind, count(*) AS n, min(seq) AS low, max(seq) AS high FROM rec GROUP BY rkind")
def log_decode(spark, d):
    """JSON lines as typed records; lines that are none are left out."""
    return _records(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))


@query("log_snapshot", f"WITH {_KINDS_SQL} SELECT * FROM folded")
def log_snapshot(spark, d):
    """All records of all kinds, folded."""
    return _shown(C.snapshot(_records(spark, d)))


@query("log_boot", f"WITH {_KINDS_SQL} SELECT * FROM folded")
def log_boot(spark, d):
    """The checkpoint at the last boundary, flushed twice, and the records behind it give what the whole log gives, for every kind."""
    records, folder = _records(spark, d), scratch(spark)
    C.flush(records, folder)
    return _shown(C.boot(records, folder, C.flush(records, folder)))


_BOUNDARY_SQL = "(SELECT max(seq) FROM log WHERE (seq + 1) % 4096 = 0)"


@query("log_trim", f"WITH {LOG_SQL} SELECT count(*) AS n FROM log WHERE seq <= {_BOUNDARY_SQL} - 4096")
def log_trim(spark, d):
    """What lies a checkpoint before the newest one."""
    rows = log(spark, d)
    newest = L.boundaries(rows).agg(F.max("seq")).first()[0]
    return L.trimmable(rows, newest if newest is not None else -1).agg(F.count(F.lit(1)).alias("n"))


@query("log_dedup", f"WITH {LOG_SQL} SELECT unit AS writer, k AS batch_id, min(seq) AS seq FROM log GROUP BY ALL")
def log_dedup(spark, d):
    rows = log(spark, d).select(F.col("unit").alias("writer"), F.lit(1).alias("incarnation"), F.col("k").alias("batch_id"), "seq")
    return L.deduplicated(rows).select("writer", "batch_id", "seq")


@query("lease_fold", f"WITH RECURSIVE {STATE_SQL} SELECT * FROM fin WHERE node >= 0")
def lease_fold(spark, d):
    return L.leases(_tenures(spark, d), ("unit",))


@query("lease_claimable", f"WITH RECURSIVE {STATE_SQL}, u AS (SELECT unnest(range(20)) AS unit) SELECT u.unit, CASE WHEN epoch IS NULL OR node < 0 THEN 1 WHEN released OR {NOW} > deadline_ms THEN epoch + 1 END AS claim_epoch FROM u LEFT JOIN fin ON fin.unit = u.unit")
def lease_claimable(spark, d):
    units = spark.range(20).withColumnRenamed("id", "unit")
    return L.claimable(lease_fold(spark, d), units, F.lit(NOW), ("unit",))


@query("lease_flags", f"WITH RECURSIVE {STATE_SQL} SELECT unit, released OR {NOW} > deadline_ms AS expired, {NOW} + 30000 >= deadline_ms AS renewal_due, {NOW} + 5000 >= deadline_ms AS must_suspend FROM fin WHERE node >= 0")
def lease_flags(spark, d):
    now = F.lit(NOW)
    return lease_fold(spark, d).select("unit", L.expired(now).alias("expired"), L.renewal_due(now).alias("renewal_due"), L.must_suspend(now).alias("must_suspend"))


_COMMITS_SQL = f"""{STATE_SQL}, c AS (SELECT seq, unit, epoch, node AS writer, k FROM log WHERE kind = 'seg_commit'),
fenced AS (SELECT c.seq, c.unit, c.k, coalesce(s.epoch = c.epoch AND s.node = c.writer AND NOT s.released, false) AS accepted FROM c ASOF LEFT JOIN st s ON c.unit = s.unit AND c.seq > s.seq)"""


def _fenced(spark, d):
    rows = log(spark, d)
    commits = rows.where("kind = 'seg_commit'").select("seq", "ord", "unit", "epoch", F.col("node").alias("writer"), "k")
    return L.fenced(commits, L.tenures(rows, ("unit",)), ("unit",))


@query("fence_commits", f"WITH RECURSIVE {_COMMITS_SQL} SELECT seq, unit, accepted FROM fenced")
def fence_commits(spark, d):
    return _fenced(spark, d).select("seq", "unit", "accepted")


@query("commit_visibility", f"WITH RECURSIVE {_COMMITS_SQL} SELECT doc_id FROM documents SEMI JOIN (SELECT DISTINCT unit, k FROM fenced WHERE accepted) f ON f.unit = doc_id % 16 AND f.k = doc_id % 100")
def commit_visibility(spark, d):
    """Rows of segments (partition, number) are visible if an accepted commit names them."""
    named = _fenced(spark, d).where("accepted").select(F.lit("seg_commit").alias("kind"), F.col("unit").alias("partition"), F.col("k").alias("seg_seq"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 16).alias("partition"), (F.col("doc_id") % 100).alias("seg_seq"))
    return visible(docs, named).select("doc_id")


@query(
    "manifest_select",
    f"""WITH RECURSIVE {STATE_SQL},
tail AS (SELECT unit, epoch, node, released, seq FROM st WHERE node >= 0),
held AS (SELECT a.unit, a.epoch, coalesce(min(b.seq) FILTER (b.epoch > a.epoch OR b.epoch = a.epoch AND b.released), 1000000000) AS held FROM (SELECT DISTINCT unit, epoch FROM tail) a JOIN tail b ON a.unit = b.unit GROUP BY ALL),
man AS (SELECT m.unit, row_number() OVER (PARTITION BY m.unit ORDER BY seq) AS rn, seq AS man_seq, seq + k % 50 * 20 AS watermark, coalesce(h.held, -1) AS held FROM log m LEFT JOIN held h ON h.unit = m.unit AND h.epoch = m.epoch WHERE kind = 'man_advance'),
walk AS (SELECT DISTINCT unit, 0::BIGINT AS rn, NULL::BIGINT AS man_seq, 0::BIGINT AS watermark FROM man
  UNION ALL SELECT w.unit, m.rn, CASE WHEN m.held >= w.watermark THEN m.man_seq ELSE w.man_seq END, CASE WHEN m.held >= w.watermark THEN m.watermark ELSE w.watermark END FROM walk w JOIN man m ON m.unit = w.unit AND m.rn = w.rn + 1)
SELECT unit, man_seq, watermark FROM walk WHERE man_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit ORDER BY rn DESC) = 1""",
)
def manifest_select(spark, d):
    rows = log(spark, d)
    end = F.coalesce(F.least("until.seq", "released_at.seq"), F.lit(1_000_000_000).cast("bigint"))
    held = L.tenures(rows, ("unit",)).select("unit", "epoch", end.alias("held"))
    man = rows.where("kind = 'man_advance'").select("unit", "epoch", F.col("seq").alias("man_seq"), (F.col("seq") + F.col("k") % 50 * 20).alias("watermark"))
    return L.select_manifests(man, held, ("unit",))


@query("ledger_stats", "SELECT user_id % 16 AS partition, count(*) AS n, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def ledger_stats(spark, d):
    """A ledger written in two parts and read back."""
    rows, folder = table(spark, d, "events"), scratch(spark)
    fetches = rows.select(F.encode(F.col("user_id").cast("string"), "UTF-8").alias("urlfp"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.lit(0).cast("bigint").alias("bytes"), "event_id")
    for part in (0, 1):
        C.write_ledger(fetches.where(F.col("event_id") % 2 == part).drop("event_id"), folder)
    return C.ledger_counts(spark.read.schema(LEDGER).parquet(folder), F.decode("urlfp", "UTF-8").cast("bigint") % 16)


@query("gc_tombstones", f"WITH {LOG_SQL} SELECT 'seg/' || lpad(seq::VARCHAR, 16, '0') AS key, (k % 3)::INT AS reason FROM log WHERE kind = 'seg_commit' AND deadline_ms <= 5000000")
def gc_tombstones(spark, d):
    """Tombstone pages written in two parts; a key named again later waits."""
    folder = scratch(spark)
    rows = log(spark, d).where("kind = 'seg_commit'").select(F.concat(F.lit("seg/"), object_key(F.col("seq"))).alias("key"), (F.col("k") % 3).cast("int").alias("reason"), F.col("deadline_ms").alias("eligible_ms"))
    C.write_tombstones(rows, folder)
    C.write_tombstones(rows.where("eligible_ms > 5000000").withColumn("eligible_ms", F.col("eligible_ms") + 1), folder)
    return C.collectable(spark.read.schema(GC_TOMBSTONE).parquet(folder), F.lit(5_000_000))


@query("source_watermarks", f"WITH {LOG_SQL} SELECT unit AS partition, max(seq) AS watermark FROM log WHERE kind = 'seg_commit' GROUP BY unit")
def source_watermarks(spark, d):
    return L.watermarks(log(spark, d).select("kind", F.col("unit").alias("partition"), "seq"))


@query("manifest_live", f"WITH {LOG_SQL} SELECT unit AS partition, seq AS seg_seq, k AS rows, seq + k AS watermark FROM log WHERE kind = 'seg_commit' AND k % 2 = 0")
def manifest_live(spark, d):
    """Two complete listings; the later one alone counts."""
    folder = scratch(spark)
    rows = log(spark, d).where("kind = 'seg_commit'").select(F.col("unit").alias("partition"), F.col("seq").alias("seg_seq"), F.col("k").alias("rows"), (F.col("seq") + F.col("k")).alias("watermark"))
    C.write_manifest(rows, folder, 1)
    C.write_manifest(rows.where("rows % 2 = 0"), folder, 2)
    return C.live_segments(spark.read.parquet(folder))


@query("frontier_section", "SELECT sha256(event_id::VARCHAR) AS urlfp, epoch_us(ts) // 1000 AS due_ms, (user_id % 7)::INT AS priority FROM events WHERE user_id % 16 = 5")
def frontier_section(spark, d):
    """A frontier of 16 sections, of which one is read."""
    folder = scratch(spark)
    rows = table(spark, d, "events").select((F.col("user_id") % 16).cast("int").alias("section_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("urlfp"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("due_ms"), (F.col("user_id") % 7).cast("int").alias("priority"))
    C.write_frontier(rows, folder)
    return C.section(spark.read.parquet(folder), 5)


@query("stream_log_fold", "SELECT user_id % 5 AS node, max(event_id) AS version, arg_max(event_type, event_id) AS kind FROM events GROUP BY ALL")
def stream_log_fold(spark, d):
    """The newest record of each node, folded by a stream over the table's files to its end."""
    from quarry.streaming import fold as S

    at = scratch(spark)
    schema = table(spark, d, "events").schema
    stream = S.tail(spark, f"{d}/events.parquet" if not _is_file(spark, f"{d}/events.parquet") else f"{d}/events.parque[t]", schema, 1000)
    rows = stream.select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("seq"), F.col("event_id").alias("version"), F.col("event_type").alias("kind"))
    S.run_to_end(S.last_of_each(rows, ["node"], ["version", "kind"]), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


def _is_file(spark, path: str) -> bool:
    """A stream takes a folder or a pattern, not one file; the check is Spark's file system's."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("querylog_bands", f"WITH {TERMS_SQL}, r AS (SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS rank, count(*) OVER () AS n FROM terms) SELECT CASE WHEN rank < greatest(1, n // 100) THEN 'head' WHEN rank < least(greatest(n // 5, greatest(1, n // 100) + 1), n) THEN 'torso' ELSE 'tail' END AS band, count(*) AS terms, sum(df)::BIGINT AS postings FROM r GROUP BY band")
def querylog_bands(spark, d):
    return bands(I.terms(doc_postings(spark, d))).groupBy("band").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))


@query("querylog_synth")
def querylog_synth(spark, d):
    return synthesize(I.terms(doc_postings(spark, d)), 200)


@query(
    "replay_report",
    """WITH o AS (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'busy' ELSE 'ok' END AS status, value AS latency, CASE WHEN event_id % 10 = 0 THEN 16 ELSE 0 END AS degrade FROM events)
SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'busy') AS busy, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'ok' AND degrade <> 0) AS degraded,
 count(*) FILTER (status = 'ok' AND latency > 20)::DOUBLE / count(*) FILTER (status = 'ok') AS over_rate, quantile_disc(latency, 0.5) FILTER (status = 'ok') AS p50, quantile_disc(latency, 0.9) FILTER (status = 'ok') AS p90, quantile_disc(latency, 0.99) FILTER (status = 'ok') AS p99, quantile_disc(latency, 0.999) FILTER (status = 'ok') AS p999, max(latency) FILTER (status = 'ok') AS max FROM o""",
)
def replay_report(spark, d):
    rows = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "busy").otherwise("ok")
    return R.report(rows.select(status.alias("status"), F.col("value").alias("latency"), F.when(F.col("event_id") % 10 == 0, 16).otherwise(0).alias("degrade")), 20)


@query("replay_governor", "SELECT event_id, CASE WHEN value / 20.0 >= 0.95 THEN 't3' WHEN value / 20.0 >= 0.8 THEN 't2' WHEN value / 20.0 >= 0.5 THEN 't1' ELSE 'full' END AS tier FROM events")
def replay_governor(spark, d):
    return table(spark, d, "events").select("event_id", R.governed(F.col("value"), F.lit(20.0)).alias("tier"))


@query("residency", f"WITH {TERMS_SQL}, s AS (SELECT 'postings' AS band, df * 8 AS bytes FROM terms UNION ALL SELECT 'terms', 32 FROM terms) SELECT band, sum(bytes)::BIGINT AS bytes, band = 'terms' AS locked FROM s GROUP BY band")
def residency(spark, d):
    each = F.array(F.struct(F.lit("postings").alias("band"), (F.col("df") * 8).alias("bytes")), F.struct(F.lit("terms").alias("band"), F.lit(32).cast("bigint").alias("bytes")))
    return R.residency(I.terms(doc_postings(spark, d)).select(F.inline(each)), ["terms"])


@query("fixture_pages")
def fixture_pages(spark, d):
    return fixture.corpus(spark, 200).select("docid", "url", "fetch_ms", "lang", "title", F.length("text").alias("chars"), "out_degree")


@query("fixture_digest")
def fixture_digest(spark, d):
    return fixture.digest(fixture.corpus(spark, 200))
