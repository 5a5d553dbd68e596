"""Generations: create once, publish, pin, advance the root, read a fixed one."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOBS = {"shards": 1, "checkpoint_every": 4096, "law_ver": 1, "tokenizer_ver": 1}


class Catalog:
    """A folder of small tables: root (one row for each advance) and generations (publish and retire events)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:  # a table that no one has written yet is empty
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def roots(self) -> DataFrame:
        return self._read("root", "version BIGINT, ckpt_seq BIGINT, knobs STRING")

    def create(self, **knobs: int) -> None:
        """Frozen knobs; a second time is an error."""
        if self.roots().limit(1).count():
            raise ValueError("exists")
        self.spark.createDataFrame([(0, 0, json.dumps(KNOBS | knobs, sort_keys=True))], "version BIGINT, ckpt_seq BIGINT, knobs STRING").write.mode("append").parquet(f"{self.path}/root")

    def root(self) -> dict:
        """The current root: the highest version."""
        row = self.roots().agg(F.max_by(F.struct("version", "ckpt_seq", "knobs"), "version").alias("r")).first().r
        return {"version": row.version, "ckpt_seq": row.ckpt_seq, "knobs": json.loads(row.knobs)}

    def advance(self, ckpt_seq: int) -> bool:
        """Forward only; standing still or going back changes nothing."""
        now = self.root()
        if ckpt_seq <= now["ckpt_seq"]:
            return False
        self.spark.createDataFrame([(now["version"] + 1, ckpt_seq, json.dumps(now["knobs"], sort_keys=True))], "version BIGINT, ckpt_seq BIGINT, knobs STRING").write.mode("append").parquet(f"{self.path}/root")
        return True

    def events(self) -> DataFrame:
        return self._read("generations", "seq BIGINT, kind STRING, shard INT, generation BIGINT, base_gen BIGINT")

    def record(self, kind: str, shard: int, generation: int, base_gen: int = 0) -> None:
        if base_gen >= generation:
            raise ValueError("a delta's base is older than itself")
        seq = (self.events().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(seq, kind, shard, generation, base_gen)], "seq BIGINT, kind STRING, shard INT, generation BIGINT, base_gen BIGINT").write.mode("append").parquet(f"{self.path}/generations")

    def pin(self) -> dict[int, int]:
        """The newest live generation of each shard; a query that has it keeps reading that one."""
        last = self.events().groupBy("shard", "generation").agg(F.max_by("kind", "seq").alias("kind")).where("kind = 'publish'")
        return {r.shard: r.generation for r in last.groupBy("shard").agg(F.max("generation").alias("generation")).collect()}


def overlay(base: DataFrame, delta: DataFrame, tombstones: DataFrame, key: str = "docid") -> DataFrame:
    """Base rows that no tombstone names, and the delta's."""
    return base.join(tombstones.select(key).distinct(), key, "left_anti").unionByName(delta)


def exclusions(tombstones: DataFrame, base_docs: int) -> DataFrame:
    """Union of the deltas' deletes over one base; naming another base is an error."""
    wrong = tombstones.where(F.col("base_docs") != base_docs).limit(1).count()
    if wrong:
        raise ValueError("tombstones of another base")
    return tombstones.select("docid").distinct()
