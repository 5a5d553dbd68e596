"""Numbers and running sums over a whole table in order, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.stored import saved

_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", total: tuple[str, str] | None = None) -> DataFrame:
    """rows with their place in the order, from 0, and, for total (column, name), the running sum of a column up to and with each row.

    Rows are dealt out by ranges of the order and stored; one sum for each range, at most as many as there are partitions, gives what comes before it. Rows that tie have
    places next to each other, which of them first isn't said. An empty table stays empty."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumns({"_o_range": F.spark_partition_id(), "_o_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
    if total:
        inside = Window.partitionBy("_o_range").orderBy("_o_place").rowsBetween(Window.unboundedPreceding, 0)
    placed = saved(placed)
    sums = placed.groupBy("_o_range").agg(F.count(F.lit(1)).alias("_o_n"), F.sum(total[0] if total else F.lit(0)).alias("_o_sum"))
    before = Window.orderBy("_o_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    sums = sums.select("_o_range", F.coalesce(F.sum("_o_n").over(before), F.lit(0)).alias("_o_first"), F.coalesce(F.sum("_o_sum").over(before), F.lit(0)).alias("_o_before"))
    both = placed.join(F.broadcast(sums), "_o_range").withColumn(name, F.col("_o_first") + F.col("_o_place"))
    if total:
        both = both.withColumn(total[1], F.col("_o_before") + F.sum(total[0]).over(inside))
    return both.drop("_o_range", "_o_place", "_o_first", "_o_before")
