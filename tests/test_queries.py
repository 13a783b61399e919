"""Every registered query against its SQL, or for rows where SQL has no say."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import TABLES, row_set

QUERIES, ORACLES = queries(), oracle_sql()
# Queries whose groups exceed the limit of the split fixture on the test tables.
SPLIT = (
    "lag_steps", "running_path", "prefix_slices", "mad_robust_z", "quantiles_linear", "spearman_rho",
    "perm_test_events", "magnitude_acf", "ols_detrend_time",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert row_set(df.columns, rows) == row_set(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    check(spark, con, sf_dir, name)


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_split_groups(spark, con, sf_dir, name):
    spark.conf.set("spark.wanderloop.groupRows", "400" if "events" not in name else "100")
    try:
        check(spark, con, sf_dir, name)
    finally:
        spark.conf.unset("spark.wanderloop.groupRows")


def test_entry_is_the_flagship(spark, sf_dir):
    assert "formal_trigger" in entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
