"""Every registered query runs, and equals its SQL twin where there is one."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

NAMES = sorted(queries())
ORACLES = oracle_sql()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, (list, np.ndarray)):
            return str([cell(y) for y in x])
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.number)):
            return repr(float(x) + 0.0)
        return str(x)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in row) for row in ordered.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    got = queries()[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["ag32_signed_rank_test", "ag32_daily_signed_rank_test", "ag32_signed_rank_test_normal", "ag32_signed_rank_test_with_nan"])
def test_rank_tests_of_users_without_differences(name, spark, tmp_path):
    """All readings of user 1 equal those they are paired with, as do those of one type on one day."""
    con = duckdb.connect()
    rows = [(1, "view", 7.0, 7), (1, "click", 5.0, 5), (2, "view", 9.5, 3), (2, "view", 4.0, 6), (3, "view", 1.25, 8)]
    values = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-0{1 + i % 2} 05:00:00', {u}::BIGINT, '{t}', {v}::DOUBLE, '{{\"k\": {k}}}')" for i, (u, t, v, k) in enumerate(rows))
    con.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert canonical(queries()[name](spark, str(tmp_path)).toPandas()) == canonical(con.execute(ORACLES[name]).fetchdf())


def test_entry(spark):
    rows = {r["policy_name"]: r for r in entry(spark).collect()}
    assert rows["current_drop_policy"]["review_topic_count"] == 0
    assert rows["route_uncertain_policy"]["review_topic_count"] == rows["route_uncertain_policy"]["uncertain_band_count"]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(NAMES)
