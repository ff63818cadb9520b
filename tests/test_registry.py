"""Every query has a result; a sample is compared with its SQL here, all of them by ``check.py``."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SAMPLE = ["b6_fan_out_ticks", "c9_shared_averages", "d4_crossover_breakout", "f19_trade_records", "g2_drawdown", "k5_trade_log_warnings", "j4_pair_summary"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and canonical(got) == canonical(want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
