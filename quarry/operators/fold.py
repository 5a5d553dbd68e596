"""The ordered log as state: leases and their fences, manifests, members, generations, tiers and checkpoints.

Every fold is a composition of aggregates keyed by what it folds, so no key's history is gathered in one row, except where manifests depend on the ones before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_CRAWL_MS, TTL_BUILD_MS, SLACK_MS = 60_000, 900_000, 5_000
CHECKPOINT_EVERY = 4096


def newest(log: DataFrame, kind: str, keys: list[str], values: list[str]) -> DataFrame:
    """The last record of each key."""
    rows = log.where(F.col("kind") == kind)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("seq", "ord")).alias("_v")).select(*keys, "_v.*")


def manifests(log: DataFrame) -> DataFrame:
    return log.where("kind = 'man_advance'").groupBy("family", "partition").agg(F.max("man_seq").alias("man_seq"))


def generations(log: DataFrame) -> DataFrame:
    """shard, generation, gen_kind of those that the last record of each publishes."""
    rows = log.where("kind IN ('gen_publish', 'gen_retire')")
    last = rows.groupBy("shard", "generation").agg(F.max_by(F.struct("kind", "gen_kind"), F.struct("seq", "ord")).alias("_v"))
    return last.where("_v.kind = 'gen_publish'").select("shard", "generation", "_v.gen_kind")


def tiers(log: DataFrame) -> DataFrame:
    """The assignments of the highest version; of equal versions the first record counts."""
    rows = log.where("kind = 'tier_map'")
    best = rows.agg(F.max_by("assign", F.struct("version", -F.col("seq"), -F.col("ord"))).alias("assign"), F.max("version").alias("version"))
    return best.select("version", F.explode("assign").alias("a")).select("version", "a.*")


def checkpoint(log: DataFrame) -> DataFrame:
    return log.where("kind = 'ckpt'").agg(F.max("ckpt_seq").alias("ckpt_seq"))


def boundaries(log: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    return log.where((F.col("seq") + 1) % every == 0).select("seq").distinct()


def tenures(log: DataFrame, keys: tuple[str, ...] = ("domain", "unit")) -> DataFrame:
    """One row for each epoch of a lease that ever held: keys, epoch, node, since, deadline_ms, released_at, until.

    An epoch holds from its first grant, if no higher epoch came before; later grants of it only move its own node's deadline forward, until it is released; until: where a higher epoch took over."""
    from pyspark.sql import Window

    keys_epoch = [*keys, "epoch"]
    order = F.struct("seq", "ord")
    grants, releases = log.where("kind = 'lease_grant'"), log.where("kind = 'lease_release'")
    first = grants.groupBy(*keys_epoch).agg(F.min(F.struct("seq", "ord", "node")).alias("f"))
    first = first.select(*keys_epoch, F.struct("f.seq", "f.ord").alias("since"), F.col("f.node").alias("node"))
    # Epochs that came after a higher one never hold.
    before = F.max("epoch").over(Window.partitionBy(*keys).orderBy("since").rowsBetween(Window.unboundedPreceding, -1))
    held = first.withColumn("_b", before).where("_b IS NULL OR epoch > _b").drop("_b")
    held = held.withColumn("until", F.lead("since").over(Window.partitionBy(*keys).orderBy("since")))
    freed = releases.select(*keys_epoch, order.alias("at")).join(held, keys_epoch).where((F.col("at") > F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))).groupBy(*keys_epoch).agg(F.min("at").alias("released_at"))
    held = held.join(freed, keys_epoch, "left")
    moves = grants.select(*keys_epoch, F.col("node").alias("_node"), "deadline_ms", order.alias("at")).join(held, keys_epoch)
    ok = (F.col("_node") == F.col("node")) & (F.col("released_at").isNull() | (F.col("at") < F.col("released_at"))) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    deadline = moves.where(ok).groupBy(*keys_epoch).agg(F.max("deadline_ms").alias("deadline_ms"))
    return held.join(deadline, keys_epoch)


def leases(tenure_rows: DataFrame, keys: tuple[str, ...] = ("domain", "unit")) -> DataFrame:
    """The state of each lease at the end: keys, epoch, node, deadline_ms, released."""
    last = tenure_rows.where("until IS NULL")
    return last.select(*keys, "epoch", "node", "deadline_ms", F.col("released_at").isNotNull().alias("released"))


def expired(now: Column) -> Column:
    return F.col("released") | (now > F.col("deadline_ms"))


def renewal_due(now: Column, ttl: int = TTL_CRAWL_MS) -> Column:
    return now + ttl // 2 >= F.col("deadline_ms")


def must_suspend(now: Column) -> Column:
    return now + SLACK_MS >= F.col("deadline_ms")


def claimable(lease_rows: DataFrame, units: DataFrame, now: Column, keys: tuple[str, ...] = ("domain", "unit")) -> DataFrame:
    """keys and claim_epoch of each unit: 1 if never held, the next epoch if expired, else null."""
    both = units.join(lease_rows, list(keys), "left")
    return both.select(*keys, F.when(F.col("epoch").isNull(), 1).when(expired(now), F.col("epoch") + 1).alias("claim_epoch"))


def fenced(commits: DataFrame, tenure_rows: DataFrame, keys: tuple[str, ...] = ("domain", "unit")) -> DataFrame:
    """commits (keys, epoch, writer, seq, ord) with accepted: the writer held the unit at exactly that epoch just before."""
    held = tenure_rows.select(*keys, "epoch", "node", "since", "until", "released_at")
    at = F.struct("seq", "ord")
    both = commits.join(held, [*keys, "epoch"], "left")
    ok = (F.col("node") == F.col("writer")) & (at > F.col("since")) & (F.col("until").isNull() | (at < F.col("until"))) & (F.col("released_at").isNull() | (at < F.col("released_at")))
    return both.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("node", "since", "until", "released_at")


def select_manifests(manifest_rows: DataFrame, held_until: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """keys and the winner's man_seq and watermark. By man_seq, a manifest is valid if its epoch was held at or after the last valid one's watermark.

    held_until: keys, epoch, held (the last position that the epoch was held at). Each manifest depends on those before it: one ordered fold for each partition's manifests."""
    rows = manifest_rows.join(held_until, [*keys, "epoch"], "left")
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("man_seq", F.coalesce("held", F.lit(-1).cast("bigint")).alias("held"), "watermark"))).alias("l"))
    start = F.struct(F.lit(None).cast("bigint").alias("man_seq"), F.lit(0).cast("bigint").alias("watermark"))
    fold = F.aggregate("l", start, lambda s, m: F.when(m["held"] >= s["watermark"], F.struct(m["man_seq"].alias("man_seq"), m["watermark"].alias("watermark"))).otherwise(s))
    return listed.select(*keys, fold.alias("w")).select(*keys, "w.*").where("man_seq IS NOT NULL")


def deduplicated(log: DataFrame) -> DataFrame:
    """Batches whose append was tried again count once."""
    first = log.groupBy("writer", "incarnation", "batch_id").agg(F.min("seq").alias("_seq"))
    return log.join(first, ["writer", "incarnation", "batch_id"]).where("seq = _seq").drop("_seq")


def trimmable(log: DataFrame, newest_checkpoint: int, interval: int = CHECKPOINT_EVERY) -> DataFrame:
    return log.where(F.col("seq") <= newest_checkpoint - interval)


def watermarks(log: DataFrame) -> DataFrame:
    """partition and the position of its last commit."""
    return log.where("kind = 'seg_commit'").groupBy("partition").agg(F.max("seq").alias("watermark"))


def state(log: DataFrame) -> dict[str, DataFrame]:
    """All folded tables."""
    return {"members": newest(log, "member", ["node"], ["endpoint", "version"]), "leases": leases(tenures(log)), "manifests": manifests(log), "generations": generations(log), "checkpoint": checkpoint(log)}


def merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
