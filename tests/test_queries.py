from __future__ import annotations

import os

import duckdb
import pytest

from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the whole list is run by the driver.
SOME = ["tok_terms", "tok_class_hist", "idx_terms_df_cf", "idx_blocks_l1", "search_topk_3terms", "search_multishard", "search_blockmax", "url_canon", "import_stats", "near_dup_classes", "degrees", "lease_fold", "fence_commits", "manifest_select", "stream_log_fold", "replay_report"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    clean = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(clean(r[i]) for i in at) for r in want.fetchall()) == sorted(tuple(clean(r[c]) for c in columns) for r in got.collect())
