"""A sample of the registered queries against DuckDB; tools/check.py runs all of them."""

import os
import sys

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["i1_build_baskets", "c5_transition_counts", "f1_f5_history_features", "r3_recommend_frequency", "r6_decay_vectors", "m9_evaluate",
          "q6_global_best", "q33_oracle_users"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    frame = entry.queries()[name](spark, FOLDER)
    mine = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns)
    assert len(mine) > 0 and compare(mine, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_every_query_has_a_callable_and_named_columns():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140
