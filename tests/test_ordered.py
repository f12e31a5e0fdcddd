"""Two-level order operators against plain numpy, with hot groups, hot values, nulls and many bucket counts."""

import numpy as np
import pandas as pd
import pytest
from helpers import close
from pyspark.sql import functions as F

from tidewatch.operators.ordered import bracket_counts, quantiles, ranked, running, with_previous, with_range_bucket
from tidewatch.operators.profile import distribution_by_label, histogram, null_counts, process_indicators, time_profile


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    group = np.where(rng.random(3000) < 0.4, "hot", rng.choice(list("abcdef"), 3000))
    value = np.where(rng.random(3000) < 0.35, 7.0, rng.normal(size=3000).round(2))
    return pd.DataFrame({"id": rng.permutation(3000), "g": group, "v": value})


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_rank_and_running(spark, rows, buckets):
    df = with_range_bucket(spark.createDataFrame(rows), "id", buckets=buckets)
    got = ranked(df, ["g"], ["id"], "rank", whole="n").toPandas()
    want = rows.sort_values("id")
    merged = got.merge(want.assign(r=want.groupby("g").cumcount() + 1, m=want.groupby("g")["id"].transform("size"))[["id", "r", "m"]], on="id")
    assert (merged["rank"] == merged["r"]).all() and (merged["n"] == merged["m"]).all()

    got = running(df, ["g"], ["id"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}).toPandas()
    want = want.assign(t=want.groupby("g")["v"].cumsum(), x=want.groupby("g")["v"].cummax())
    merged = got.merge(want[["id", "t", "x"]], on="id")
    assert len(merged) == 3000 and np.allclose(merged["total"], merged["t"]) and (merged["top"] == merged["x"]).all()


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_previous_row(spark, rows, buckets):
    df = with_range_bucket(spark.createDataFrame(rows), "id", buckets=buckets)
    got = with_previous(df, ["g"], "id", {"before": "v"}).toPandas().sort_values("id")
    want = rows.sort_values("id")
    want = want.assign(b=want.groupby("g")["v"].shift())
    assert np.allclose(got["before"].astype(float), want["b"].astype(float), equal_nan=True)


@pytest.mark.parametrize("buckets", [1, 9, 200])
def test_quantiles(spark, rows, buckets):
    df = spark.createDataFrame(rows)
    got = quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}, buckets=buckets).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q95", 0.95)):
            assert close(got.loc[g, name], np.quantile(part["v"], q))


@pytest.mark.parametrize("shape", ["sorted", "equal", "skewed", "few values", "reversed"])
def test_brackets_of_large_groups(spark, shape):
    """Exact whatever the order and repeats; under 5 % of the readings are counted one by one."""
    n = 60_000
    rng = np.random.default_rng(4)
    v = {"sorted": np.arange(n) / 7, "reversed": -np.arange(n) / 3, "equal": np.full(n, 2.5), "skewed": rng.pareto(0.3, n),
         "few values": rng.integers(0, 9, n).astype(float)}[shape]
    rows = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "hot", np.where(np.arange(n) % 3 == 1, "b", "c")), "v": v})
    probs = {"least": 0.0, "q25": 0.25, "q26": 0.26, "q50": 0.5, "q95": 0.95, "most": 1.0}
    df = spark.createDataFrame(rows).repartition(5)
    got = quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    ranked_ = quantiles(df, ["g"], "v", probs, nearest_rank=True).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        for name, q in probs.items():
            assert close(got.loc[g, name], np.quantile(part["v"], q))
            assert ranked_.loc[g, name] == np.sort(part["v"])[max(0, int(np.ceil(q * len(part))) - 1)]
    if shape in ("sorted", "skewed", "reversed"):
        counts = bracket_counts(df, ["g"], "v", {"q50": 0.5, "q95": 0.95})
        assert counts.where("_v is not null").agg(F.sum("_c")).first()[0] < 0.05 * n and counts.agg(F.sum("_c")).first()[0] == n


def test_quantiles_leave_nan_and_empty_groups_out(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 9)] + [("a", nan), ("a", None), ("b", nan)], "g string, v double")
    assert [(r["g"], r["m"]) for r in quantiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("a", 4.5)]
    assert quantiles(df.where("g = 'b'"), [], "v", {"m": 0.5}).collect()[0]["m"] is None if quantiles(df.where("g = 'b'"), [], "v", {"m": 0.5}).count() else True
    box = {r["label"]: r for r in distribution_by_label(df.withColumnRenamed("g", "label"), "label", "v").collect()}
    assert (box["a"]["n"], box["a"]["highest"], box["a"]["median"], box["b"]["n"], box["b"]["median"]) == (8, 8.0, 4.5, 0, None)
    assert {r["column_name"]: r["missing"] for r in null_counts(df, ["v"]).collect()} == {"v": 3}


def test_both_p95_definitions(spark):
    df = spark.range(1, 31).select(F.col("id").cast("double").alias("x"))
    assert quantiles(df, [], "x", {"p": 0.95}, nearest_rank=True).first()["p"] == 29.0
    assert close(quantiles(df, [], "x", {"p": 0.95}).first()["p"], 28.55)


def test_null_group_keys_are_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "")], "id int, g string")
    got = {r["id"]: (r["rank"], r["n"]) for r in ranked(with_range_bucket(df, "id"), ["g"], ["id"], "rank", whole="n").collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 1), 4: (1, 1)}


def test_time_profile_of_shuffled_time(spark):
    df = spark.createDataFrame([(0, 5.0, 0), (1, 3.0, 1), (2, 9.0, 0), (3, 1.0, 1)], "id int, t double, label int")
    r = time_profile(df, "id", "t", "label").first()
    assert (r["time_span"], r["first_anomaly_row"], r["first_anomaly_row_ts"], r["first_anomaly_ts"]) == (8.0, 1, 3.0, 1.0)
    assert r["steps_back"] == 2 and r["monotonic"] is False


def test_energy_is_a_trapezoid(spark):
    df = spark.createDataFrame([(0, 0.0, 0, 2.0), (1, 1.0, 0, 4.0), (2, 3.0, 1, 0.0)], "id int, t double, label int, p double")
    r = process_indicators(df, "id", "t", "label", F.col("p")).first()
    assert close(r["energy"], 3.0 + 4.0) and r["median_power"] == 2.0 and r["window_seconds"] == 3.0
    assert close(r["anomaly_minus_normal"], -3.0)


def test_histogram_edges_and_constant_column(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(101)], "a double, b double")
    bins = {(r["column_name"], r["bin"]): r["n"] for r in histogram(df, ["a", "b"]).collect()}
    assert bins[("a", 49)] == 3 and bins[("a", 0)] == 2 and bins[("b", 0)] == 101
    assert sum(n for (c, _), n in bins.items() if c == "a") == 101


def test_null_counts_only_missing(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert [(r["column_name"], r["missing"]) for r in null_counts(df, only_missing=True).collect()] == [("b", 1)]


def test_time_columns_can_be_the_order(spark):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, day date")
    for order in ("ts", "day"):
        got = ranked(with_range_bucket(df, order, buckets=6), [], [order], "rank").collect()
        assert all(r["rank"] == r["id"] + 1 for r in got)


def test_hot_group_is_spread_over_buckets(spark):
    """A group with a third of all rows is cut about as finely as its share of the buckets."""
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    largest = with_range_bucket(df, "id", buckets=30).groupBy("g", "_bucket").count().agg(F.max("count")).first()[0]
    assert largest < 3 * 10_000 / 30


def test_one_scan_finds_the_cuts_of_several_columns(spark):
    from tidewatch.operators.ordered import range_cuts

    df = spark.createDataFrame([(float(i), None if i % 2 else -float(i)) for i in range(100)], "a double, b double")
    cuts = range_cuts(df, ["a", "b"], buckets=4)
    assert len(cuts["a"]) == 3 and cuts["a"] == sorted(cuts["a"]) and max(cuts["b"]) < 0
