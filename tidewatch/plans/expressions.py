"""Scalar functions, labelling, cleaning and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.portable import clip01, millis_to_timestamp, ratio, seconds_to_timestamp, uniform
from ..operators import cleaning, scaling
from .registry import query
from .views import events, rounded, sensors, table, u_sql, vectors, with_events, with_sensors, with_vectors


def psi(x: str, amplitude: float = 1.0) -> str:
    return f"({amplitude * scalar.WAVELET_PREFACTOR!r}::DOUBLE * (1 - ({x}) * ({x})) * exp(-(({x}) * ({x})) / 2))"


@query("sc01_wavelet", with_events(f"SELECT event_id, round({psi('value / 10')}, 6) AS psi, round({psi('value / 10', 2.0)}, 6) AS psi2 FROM e"))
def wavelet(spark, sf):
    x = F.col("value") / 10
    return rounded(events(spark, sf).select("event_id", scalar.wavelet(x).alias("psi"), scalar.wavelet(x, 2.0).alias("psi2")))


@query("sc02_wavelet_label", with_sensors(f"""
SELECT label, count(*) AS n, CAST(sum(CASE WHEN greatest(abs({psi('"I_w_BLO_Weg"', 2.0)}), abs({psi('"O_w_BHL_power" * 10', 2.0)}),
 abs({psi('"O_w_BHL_voltage"* 10', 2.0)})) > 0.6::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM s GROUP BY label"""))
def wavelet_label(spark, sf):
    s = sensors(spark, sf).select("label", "I_w_BLO_Weg", (F.col("O_w_BHL_power") * 10).alias("O_w_BHL_power"),
                                  (F.col("O_w_BHL_voltage") * 10).alias("O_w_BHL_voltage")).withColumn("wave", F.lit(0))
    out = cleaning.wavelet_label(s, ["I_w_BLO_Weg", "O_w_BHL_power", "O_w_BHL_voltage"], "wave", amplitude=2.0)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("wave").alias("flagged"))


@query("sc02_wavelet_label_default", with_sensors(f"""
SELECT CASE WHEN greatest(abs({psi('"I_w_BLO_Weg"')}), abs({psi('"O_w_BLO_power"')}), abs({psi('"O_w_BHL_power"')})) > 0.6::DOUBLE THEN 1 ELSE label END AS label,
 count(*) AS n FROM s GROUP BY 1"""))
def wavelet_label_default(spark, sf):
    out = cleaning.wavelet_label(sensors(spark, sf), ["I_w_BLO_Weg", "O_w_BLO_power", "O_w_BHL_power"], "label")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("sc03_z_score", with_events("""
SELECT event_id, round((value - m) / s, 6) AS z, abs((value - m) / s) > 3 AS outlying FROM e, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM e)"""))
def z_score(spark, sf):
    e = events(spark, sf).select("event_id", "value")
    stats = e.agg(F.struct(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).alias("z")).scalar()
    z = scalar.z_score("value", F.col("st.m"), F.col("st.s"))
    return e.withColumn("st", stats).select("event_id", F.round(z, 6).alias("z"), (F.abs(z) > 3).alias("outlying"))


def _round_sql(i: int, column: str) -> str:
    src = f"r{i - 1}" if i else "lineitem"
    return (f"r{i} AS (SELECT t.* FROM {src} t, (SELECT avg({column}) AS m, stddev_samp({column}) AS s FROM {src}) "
            f"WHERE NOT coalesce(abs(({column} - m) / nullif(s, 0)) > 1.5, false))")


CLEANED = ["l_quantity", "l_extendedprice", "l_tax"]


@query("sc04_sequential_outliers", "WITH " + ", ".join(_round_sql(i, c) for i, c in enumerate(CLEANED)) + """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM r2 GROUP BY 1""")
def sequential_outliers(spark, sf):
    kept = cleaning.remove_outliers(table(spark, sf, "lineitem").select("l_returnflag", *CLEANED), CLEANED, limit=1.5)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("sc04_outliers_at_once", "SELECT l_returnflag, count(*) AS n FROM lineitem, (SELECT " + ", ".join(
    f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(CLEANED)) + " FROM lineitem) WHERE " + " AND ".join(
    f"NOT abs(({c} - m{i}) / s{i}) > 1.5" for i, c in enumerate(CLEANED)) + " GROUP BY 1")
def outliers_at_once(spark, sf):
    kept = cleaning.remove_outliers_at_once(table(spark, sf, "lineitem").select("l_returnflag", *CLEANED), CLEANED, 1.5)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _scaled_sql(formula: str, stats: str) -> str:
    """Scaled value and k per event, from one-row statistics of each column."""
    cols = ", ".join(f"round({formula.format(c=c)}, 6) AS {c}" for c in ("value", "k"))
    facts = ", ".join(stats.format(c=c) for c in ("value", "k"))
    return with_events(f"SELECT event_id, {cols} FROM e, (SELECT {facts} FROM e) st")


def _scaled(fn, spark, sf, **kw):
    return rounded(fn(events(spark, sf).select("event_id", "value", "k"), ["value", "k"], **kw))


@query("sc05_standard_scaling", _scaled_sql("(e.{c} - m_{c}) / s_{c}", "avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}"))
def standard_scaling(spark, sf):
    return _scaled(scaling.standard, spark, sf)


@query("sc05_standard_scaling_population", _scaled_sql("(e.{c} - m_{c}) / s_{c}", "avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"))
def standard_scaling_population(spark, sf):
    return _scaled(scaling.standard, spark, sf, population=True)


@query("sc06_min_max_scaling", _scaled_sql("(e.{c} - lo_{c}) / (hi_{c} - lo_{c})::DOUBLE", "min({c}) AS lo_{c}, max({c}) AS hi_{c}"))
def min_max_scaling(spark, sf):
    return _scaled(scaling.min_max, spark, sf)


@query("sc07_robust_scaling", _scaled_sql("(e.{c} - q5_{c}) / (q9_{c} - q1_{c})",
    "quantile_cont({c}::DOUBLE, 0.1) AS q1_{c}, quantile_cont({c}::DOUBLE, 0.5) AS q5_{c}, quantile_cont({c}::DOUBLE, 0.9) AS q9_{c}"))
def robust_scaling(spark, sf):
    return _scaled(scaling.robust, spark, sf)


@query("sc08_min_shift", _scaled_sql("(e.{c} - lo_{c})::DOUBLE", "min({c}) AS lo_{c}"))
def min_shift(spark, sf):
    return _scaled(scaling.min_shift, spark, sf)


CENTRE = "c AS (SELECT list(m ORDER BY i) AS centre FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v) GROUP BY i))"


def _with_centre(spark, sf):
    """Vectors beside the mean vector, which is one row."""
    v = vectors(spark, sf)
    means = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return v.withColumn("centre", centre.scalar())


@query("sc09_distance", with_vectors("SELECT vec_id, round(list_distance(v, centre), 6) AS distance FROM v, c", CENTRE))
def distance(spark, sf):
    return rounded(_with_centre(spark, sf).select("vec_id", scalar.distance("v", "centre").alias("distance")))


@query("sc10_interpolate", with_vectors(f"""
SELECT vec_id, round(v[1] + (centre[1] - v[1]) * t, 6) AS first, round(v[64] + (centre[64] - v[64]) * t, 6) AS last
FROM (SELECT *, {u_sql('3', 'vec_id')} AS t FROM v), c""", CENTRE))
def interpolate(spark, sf):
    v = _with_centre(spark, sf).withColumn("t", uniform(3, "vec_id"))
    mixed = v.select("vec_id", scalar.interpolate("v", "centre", F.col("t")).alias("m"))
    return rounded(mixed.select("vec_id", F.col("m")[0].alias("first"), F.col("m")[63].alias("last")))


@query("sc11_route", with_events("""
SELECT event_id, CASE WHEN score > 0.8::DOUBLE THEN 'anomaly' WHEN score <= 0.2::DOUBLE THEN 'normal' ELSE 'uncertain' END AS route FROM e"""))
def route(spark, sf):
    return events(spark, sf).select("event_id", scalar.route("score").alias("route"))


@query("sc12_latency", with_events(f"""
SELECT event_id, greatest(0, CAST(floor({u_sql('7', 'event_id')} * 5000) AS BIGINT) - 200) AS latency_ms FROM e"""))
def latency(spark, sf):
    e = events(spark, sf).withColumn("ms", F.expr("ts_us div 1000"))
    done = F.col("ms") + F.floor(uniform(7, "event_id") * 5000).cast("bigint") - 200
    return e.select("event_id", scalar.latency_ms("ms", done).alias("latency_ms"))


@query("sc13_json_fields", with_events("SELECT event_id, k::DOUBLE AS number, CAST(k AS VARCHAR) AS text FROM e"))
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.json_number("props", "k").alias("number"),
                                             scalar.json_string("props", "k").alias("text"))


@query("sc14_json_build", with_events("""
SELECT event_id, '"' || event_type || '"' AS kind, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS number,
 true AS keeps_null FROM e"""))
def json_build(spark, sf):
    t = table(spark, sf, "events")
    body = scalar.json_object({"kind": F.to_json(F.struct(F.col("event_type").alias("x"))), "number": scalar.number_text("value"),
                               "gone": F.lit(None).cast("double")})
    t = t.withColumn("body", body)
    inner = F.get_json_object(F.get_json_object("body", "$.kind"), "$.x")
    return t.select("event_id", F.concat(F.lit('"'), inner, F.lit('"')).alias("kind"),
                    F.get_json_object("body", "$.number").alias("number"), F.col("body").contains('"gone":null').alias("keeps_null"))


@query("sc16_safe_divide", with_events("SELECT event_id, round(coalesce(value / nullif(hr, 0), 0), 6) AS share FROM e"))
def safe_divide(spark, sf):
    return rounded(events(spark, sf).select("event_id", ratio("value", "hr").alias("share")))


@query("sc17_clip_rate", with_events("SELECT event_id, round(least(greatest(value / 50 - 0.5, 0), 1), 6) AS rate FROM e"))
def clip_rate(spark, sf):
    return rounded(events(spark, sf).select("event_id", clip01(F.col("value") / 50 - 0.5).alias("rate")))


@query("sc18_reconstruction_error", with_vectors("SELECT vec_id, round(power(list_distance(v, centre), 2) / 64, 6) AS error FROM v, c", CENTRE))
def reconstruction_error(spark, sf):
    return rounded(_with_centre(spark, sf).select("vec_id", scalar.reconstruction_error("v", "centre").alias("error")))


@query("sc22_timestamp_parse", with_events("""
SELECT event_id, make_timestamp((ts_us // 1000000) * 1000000) AS by_seconds, make_timestamp((ts_us // 1000) * 1000) AS by_millis FROM e"""))
def timestamp_parse(spark, sf):
    return events(spark, sf).select(
        "event_id", seconds_to_timestamp(F.expr("ts_us div 1000000")).alias("by_seconds"),
        millis_to_timestamp(F.expr("ts_us div 1000")).alias("by_millis"))
