"""Load reports over outcomes of replayed queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import numbered

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def report(outcomes: DataFrame, budget: float) -> DataFrame:
    """outcomes: status (ok, busy, error), latency, degrade. Latencies are of ok ones alone; percentiles are nearest-rank; over is strictly more than the budget."""
    ok = F.col("status") == "ok"
    share = lambda c: F.count_if(c).cast("double") / F.count_if(ok)
    latency = "CASE WHEN status = 'ok' THEN latency END"
    disc = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {latency})").alias(n) for n, p in PERCENTILES.items()]
    return outcomes.agg(
        F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "busy").alias("busy"), F.count_if(F.col("status") == "error").alias("error"),
        F.count_if(ok & (F.col("degrade") != 0)).alias("degraded"), share(ok & (F.col("latency") > budget)).alias("over_rate"), *disc, F.max(F.expr(latency)).alias("max"),
    )


def arrivals(ids: DataFrame, qps: float, seed: int = 1, key: str = "id") -> DataFrame:
    """at: the open-loop arrival time in seconds of each id, gaps exponential."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return numbered(ids.withColumn("gap", -F.log(u) / qps), [key], "_place", ("gap", "at")).drop("_place")


def governed(elapsed: Column, budget: Column) -> Column:
    """Model of a governor: which tier a query is in by the share of its budget that is spent."""
    share = elapsed / budget
    return F.when(share >= 0.95, "t3").when(share >= 0.8, "t2").when(share >= 0.5, "t1").otherwise("full")


def residency(sizes: DataFrame, locked: list[str]) -> DataFrame:
    """band, bytes, locked of a table of file sizes."""
    return sizes.groupBy("band").agg(F.sum("bytes").alias("bytes")).withColumn("locked", F.col("band").isin(locked))
