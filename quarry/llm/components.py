"""Connected components of links as a DataFrame loop: no link or component goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.line_dedup import discard, scratch


#: Links that one task contracts at once.
EDGES = 2_000_000


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes, each to the smallest that EDGES links of a partition connect it with: paths become stars, so few rounds are left."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (pa.chunked_array([x.column(c) for x in held]).combine_chunks() for c in (0, 1))
        both = pa.concat_arrays([a, b])
        nodes = pa.compute.unique(both)
        nodes = nodes.take(pa.compute.sort_indices(nodes))
        at = pa.compute.index_in(both, nodes).to_numpy(zero_copy_only=False)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            least = label.copy()
            np.minimum.at(least, x, label[y])
            np.minimum.at(least, y, label[x])
            np.minimum.at(least, label, least.copy())  # what a node finds its label has too
            least = least[least]
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(label[some]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    return links.mapInArrow(run, links.select("a", "b").schema)


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """node, label for every node of links (a, b): label is the smallest node that it reaches.

    The links are contracted in parts first, and once more in as few parts as EDGES allows. Then each round every node takes the smallest label of its neighbours, then the label of its label. The labels are written to a shared folder every round, so
    lineage stays short and a lost executor costs one round. Empty links give no rows."""
    spark, folder = links.sparkSession, folder or scratch(links.sparkSession)
    contracted(links.select("a", "b").where("a <> b")).write.parquet(f"{folder}/stars")
    stars = spark.read.parquet(f"{folder}/stars")
    links = contracted(stars.coalesce(-(-stars.count() // EDGES) or 1))
    links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().write.parquet(f"{folder}/links")
    both = spark.read.parquet(f"{folder}/links")
    both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")).write.parquet(f"{folder}/labels-0")
    k = 0
    while True:
        now = spark.read.parquet(f"{folder}/labels-{k}")
        around = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        k += 1
        step.write.parquet(f"{folder}/labels-{k}")
        done = spark.read.parquet(f"{folder}/labels-{k}")
        discard(spark, f"{folder}/labels-{k - 1}")
        if not done.where("old <> label").limit(1).count():
            discard(spark, f"{folder}/stars", f"{folder}/links")
            return done.select("node", "label")
