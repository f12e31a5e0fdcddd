"""Hand-computed values of column expressions."""

import pytest
from helpers import close
from pyspark.sql import functions as F

from tidewatch.functions import portable, scalar
from tidewatch.operators import cleaning


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wavelet_peak_and_flag(spark):
    assert close(one(spark, scalar.wavelet(F.lit(0.0))), 0.433663, 1e-5)
    assert close(one(spark, scalar.wavelet(F.lit(0.0), 2.0)), 0.867325, 1e-5)
    df = spark.createDataFrame([(0.0, None, 0), (3.0, 0.0, 1), (None, None, 1), (0.47, 9.0, 0), (0.48, 9.0, 0)],
                               "a double, b double, label int")
    at = lambda amplitude: [r["label"] for r in cleaning.wavelet_label(df, ["a", "b"], amplitude=amplitude).collect()]
    assert at(1.0) == [0, 1, 1, 0, 0]
    assert at(2.0) == [1, 1, 1, 1, 0]


@pytest.mark.parametrize("score, band", [(0.2, "normal"), (0.2000001, "uncertain"), (0.8, "uncertain"),
                                         (0.8000001, "anomaly"), (None, None)])
def test_route_bounds(spark, score, band):
    assert one(spark, scalar.route(F.lit(score).cast("double"))) == band


def test_null_score_is_normal_on_the_live_path(spark):
    from tidewatch.operators.routing import with_route

    df = spark.createDataFrame([(None,)], "score double")
    assert with_route(df, null_is_zero=True).first()["route"] == "normal"
    assert with_route(df).first()["route"] is None


@pytest.mark.parametrize("text, as_int, as_long", [("1", 1, 1), ("1.9", 1, 1), ("x", -1, 0), (None, -1, 0), ("", -1, 0), ("-2.5", -2, -2)])
def test_lenient_casts(spark, text, as_int, as_long):
    c = F.lit(text).cast("string")
    assert one(spark, portable.lenient_int(c)) == as_int
    assert one(spark, portable.lenient_long(c)) == as_long


@pytest.mark.parametrize("text, shown", [("3.0", "3"), ("3.25", "3.25"), (" 7 ", "7"), ("", None), ("abc", None), ("-0.5", "-0.5")])
def test_number_text(spark, text, shown):
    assert one(spark, scalar.number_text(F.lit(text))) == shown


def test_safe_divide_and_clip(spark):
    assert one(spark, portable.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, portable.ratio(F.lit(1), F.lit(4))) == 0.25
    assert [one(spark, portable.clip01(F.lit(v))) for v in (-1.0, 0.5, 2.0)] == [0.0, 0.5, 1.0]


def test_order_key_matches_its_published_value(spark):
    assert one(spark, (portable.uniform(42, F.lit(7)) * 4294967296).cast("bigint")) == 1409445407


def test_json_keeps_nulls_and_escapes(spark):
    body = one(spark, scalar.json_object({"a": F.lit('q"\\'), "b": F.lit(None).cast("double")}))
    assert body == '{"a":"q\\"\\\\","b":null}'


def test_groups_only_when_divisible(spark):
    flat = F.array(*[F.lit(float(i)) for i in range(6)])
    assert one(spark, scalar.grouped(flat, 3)) == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    assert one(spark, scalar.grouped(flat, 4)) is None


def test_latency_is_never_negative(spark):
    assert one(spark, scalar.latency_ms(F.lit(10), F.lit(3))) == 0


def test_timestamps_are_zone_free(spark):
    import datetime as dt

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, portable.seconds_to_timestamp(F.lit(1.5))) == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)
        assert one(spark, portable.millis_to_timestamp(F.lit(2500))) == dt.datetime(1970, 1, 1, 0, 0, 2, 500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_constant_column_drops_nothing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (100.0, 5.0)], "a double, b double")
    assert cleaning.remove_outliers(df, ["b"]).count() == 3
    assert cleaning.remove_outliers(df.limit(1), ["a"]).count() == 1
    assert cleaning.remove_outliers_at_once(df, ["b"]).count() == 3


def test_outliers_are_removed_column_after_column(spark):
    rows = [(float(i % 5), float(i % 7)) for i in range(200)] + [(1000.0, 3.0), (2.0, 500.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    import numpy as np

    a = np.array(rows)
    for c in (0, 1):
        a = a[np.abs((a[:, c] - a[:, c].mean()) / a[:, c].std(ddof=1)) <= 3]
    assert cleaning.remove_outliers(df, ["a", "b"]).count() == len(a)
