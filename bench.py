"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each runs once to warm up, then counts the better of two runs, or of one if the first took over SLOW seconds. Every figure goes to stderr as soon as it is there. After
BUDGET seconds, or on SIGTERM, what is measured by then is printed, with the names of what isn't."""

from __future__ import annotations

import json
import os
import shutil
import signal
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph, index, ingest, search
from quarry.plans import catalogue
from quarry.plans.common import table
from quarry.sources.querylog import synthesize


SLOW, BUDGET = 30, 1200


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    folder = tempfile.mkdtemp(prefix="bench-index-")
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    queries = catalogue.queries()

    def index_build() -> None:
        index.write_index(docs, folder)

    def batch_search() -> None:
        """200 synthetic queries, top 100 of each, over the index on disk."""
        terms = index.load(spark, folder, "terms").select("term", "df")
        asked = synthesize(terms, 200).select("query_id", F.explode("terms").alias("term")).withColumns({"op": F.lit(0), "times": F.lit(1)})
        noop(search.search(index.load(spark, folder, "postings").select("term", "docid", "tf", "shard"), asked, 100))

    work = {
        "index_build": index_build,
        "batch_search_200": batch_search,
        "tf_df_cf": lambda: noop(queries["idx_terms_df_cf"](spark, sf_dir)),
        "url_canon": lambda: noop(queries["url_canon"](spark, sf_dir)),
        "import_pages": lambda: noop(queries["import_pages"](spark, sf_dir)),
        "hash_documents": lambda: noop(graph.simhashes(docs).join(docs.select(F.col("doc_id").alias("docid"), F.sha2("text", 256).alias("sha")), "docid")),
        "near_dup_pairs": lambda: noop(queries["near_dup_pairs"](spark, sf_dir)),
        "outlinks_degrees": lambda: noop(queries["degrees"](spark, sf_dir)),
        "lease_fold": lambda: noop(queries["lease_fold"](spark, sf_dir)),
        "fence_commits": lambda: noop(queries["fence_commits"](spark, sf_dir)),
        "dedup_first_wins": lambda: noop(ingest.first_wins(docs.select("doc_id", "source", F.sha2("text", 256).alias("sha")), ["source", "sha"], "doc_id")),
    }
    pages.count()
    took: dict[str, float] = {}

    def report(*_signal) -> None:
        missing = [n for n in work if n not in took]
        line = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]} | ({"missing": missing} if missing else {})
        print(json.dumps(line), flush=True)
        if _signal:
            os._exit(0)

    signal.signal(signal.SIGTERM, report)
    start = time.perf_counter()
    for name, run in work.items():
        best = float("inf")
        for k in range(3):
            began = time.perf_counter()
            run()
            last = time.perf_counter() - began
            if k:
                best = min(best, last)
                if last > SLOW:
                    break
        took[name] = round(best, 3)
        print(f"{name}: {took[name]} s", file=sys.stderr, flush=True)
        if time.perf_counter() - start > BUDGET:
            break
    shutil.rmtree(folder, ignore_errors=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
