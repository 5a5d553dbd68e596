"""The log fold as a stream: file-source tail, keyed state, checkpoints by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """The log's files in order, so many a trigger; each is seen once for each checkpoint folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def last_of_each(stream: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The newest record of each key; state is one row a key."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("_v")).select(*keys, "_v.*")


def run_to_end(out: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """All that is there now, then stop; a second run goes on where the first stopped. In complete mode path holds the newest state only."""

    def put(rows: DataFrame, _batch: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    epoch, node, deadline, released, seen = state.get if state.exists else (0, -1, 0, False, -1)
    for r in pd.concat(list(batches)).sort_values("seq").itertuples():
        if r.seq <= seen:
            continue
        seen = r.seq
        if r.kind == "lease_grant":
            if r.epoch > epoch:
                epoch, node, deadline, released = r.epoch, r.node, r.deadline_ms, False
            elif r.epoch == epoch and r.node == node and not released:
                deadline = max(deadline, r.deadline_ms)
        elif r.kind == "lease_release" and r.epoch == epoch:
            released = True
    state.update((int(epoch), int(node), int(deadline), bool(released), int(seen)))
    yield pd.DataFrame({"unit": [key[0]], "epoch": [epoch], "node": [node], "deadline_ms": [deadline], "released": [released], "seq": [seen]})


def lease_stream(stream: DataFrame) -> DataFrame:
    """State of each unit's lease after each trigger (unit, epoch, node, deadline_ms, released, seq); the highest seq of a unit is its newest. A unit's state is five numbers, whatever its history."""
    rows = stream.where("kind IN ('lease_grant', 'lease_release')").select("unit", "seq", "kind", "epoch", "node", "deadline_ms")
    return rows.groupBy("unit").applyInPandasWithState(
        _lease, "unit long, epoch long, node long, deadline_ms long, released boolean, seq long", "epoch long, node long, deadline_ms long, released boolean, seen long", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Extension: counts of event-time windows with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: sessions that end after a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
