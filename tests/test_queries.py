"""Every query with SQL against DuckDB at the smallest scale, and results that do not depend on partitions."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from dimlark.plans import drawing_queries, ledger_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = ledger_queries.QUERIES | drawing_queries.QUERIES, ledger_queries.ORACLE | drawing_queries.ORACLE


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    cell = lambda v: "-" if v is None else str(v) if isinstance(v, (bool, np.bool_, str)) else f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float, np.number)) else str(v)
    return sorted("|".join(map(cell, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", ["verdict_summary", "WIN-4", "ROW-12", "LIN-12", "DET-2", "GEO-8", "DET-10"])
def test_partitions_do_not_matter(spark, sf, name):
    first = shown(QUERIES[name](spark, sf).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert shown(QUERIES[name](spark, sf).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(QUERIES) <= set(contract.queries())
