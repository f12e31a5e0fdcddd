"""Labelled views over the given tables, and the same views as SQL.

``events`` plays the sensor stream: an error is an anomaly, and a seeded hash
gives every record a score that fills all three route bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.portable import epoch_micros, uniform
from ..operators.metrics import confusion, run_summary, with_measures

EPOCH_MS = 1704067200000  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column, for value checks across engines."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uniform(42, "event_id")
    label = (F.col("event_type") == "error").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", epoch_micros("ts").alias("ts_us"), (epoch_micros("ts") / F.lit(1000000.0)).alias("ts_s"),
        "user_id", "event_type", "value", F.from_json("props", "k INT")["k"].alias("k"),
        F.hour("ts").alias("hr"), label.alias("label"), u.alias("u"),
        F.least(F.lit(1.0), F.lit(0.6) * u + F.lit(0.4) * label).alias("score"))


EVENTS = """
e0 AS (SELECT *, CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
       CAST(event_type = 'error' AS INTEGER) AS label FROM events),
e AS (SELECT event_id, ts, epoch_us(ts) AS ts_us, epoch_us(ts)::DOUBLE / 1000000.0::DOUBLE AS ts_s, user_id, event_type, value,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(hour(ts) AS INTEGER) AS hr, label, u,
      least(1.0::DOUBLE, 0.6::DOUBLE * u + 0.4::DOUBLE * label) AS score FROM e0)"""

ROUTE = "CASE WHEN score > 0.8::DOUBLE THEN 'anomaly' WHEN score <= 0.2::DOUBLE THEN 'normal' ELSE 'uncertain' END"


def with_events(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([EVENTS, *ctes]) + " " + body


def u_sql(seed: str, expr: str) -> str:
    """SQL twin of ``uniform``."""
    return f"(CAST('0x' || substr(md5('{seed}:' || {expr}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label",
        (F.col("label") == 5).cast("int").alias("y"))


VECTORS = ("v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, "
           "CAST(label = 5 AS INTEGER) AS y FROM embeddings)")


def with_vectors(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([VECTORS, *ctes]) + " " + body


SENSOR_COLUMNS = ["I_w_BLO_Weg", "O_w_BLO_power", "O_w_BHL_power", "O_w_BHL_voltage"]


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` under sensor column names; a zero discount reads as a missing voltage."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("I_w_BLO_Weg"),
        F.col("l_extendedprice").alias("O_w_BLO_power"), F.col("l_tax").alias("O_w_BHL_power"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("O_w_BHL_voltage"))


SENSORS = """s AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_quantity AS "I_w_BLO_Weg",
 l_extendedprice AS "O_w_BLO_power", l_tax AS "O_w_BHL_power",
 CASE WHEN l_discount <> 0 THEN l_discount END AS "O_w_BHL_voltage" FROM lineitem)"""


def with_sensors(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([SENSORS, *ctes]) + " " + body


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of many models (one per user) on four data sets (one per quarter of the day), by weekly run."""
    e = events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("d"), F.floor(F.col("hr") / 6).cast("string")).alias("dataset"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("model"),
        F.concat(F.lit("f"), F.pmod("user_id", F.lit(3)).cast("string")).alias("family"),
        F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("run"), "label",
        (F.col("score") >= 0.5).cast("int").alias("prediction"),
        (uniform(10042, "event_id") < 0.2).cast("int").alias("baseline"))


PREDICTIONS = f"""p AS (SELECT 'd' || CAST(hr // 6 AS VARCHAR) AS dataset, 'u' || user_id AS model,
 'f' || (user_id % 3) AS family, CAST((day(ts) - 1) // 7 AS INTEGER) AS run, label,
 CAST(score >= 0.5 AS INTEGER) AS prediction, CAST({u_sql('10042', 'event_id')} < 0.2 AS INTEGER) AS baseline FROM e)"""


def cells_sql(source: str, keys: str, prediction: str = "prediction") -> str:
    """Confusion counts per group as SQL."""
    part = lambda n, a, b: f"count(*) FILTER (label = {a} AND {prediction} = {b}) AS {n}"
    listed = ", ".join([part("tp", 1, 1), part("tn", 0, 0), part("fp", 0, 1), part("fn", 1, 0)])
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}{listed} FROM {source}" + (f" GROUP BY {keys}" if keys else "")


def measures_sql(source: str) -> str:
    """Measures over confusion counts as SQL."""
    div = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0::DOUBLE)"
    p, r = div("tp", "tp + fp"), div("tp", "tp + fn")
    return (f"SELECT *, {div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {p} AS precision, {r} AS recall, "
            f"{div(f'2.0::DOUBLE * {p} * {r}', f'{p} + {r}')} AS f1, {div('fp + fn', 'tp + tn + fp + fn')} AS error_rate "
            f"FROM ({source})")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_measures(confusion(predictions(spark, sf_dir), "label", "prediction",
                                   ["dataset", "model", "family", "run"]))


def baseline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_measures(confusion(predictions(spark, sf_dir), "label", "baseline",
                                   ["dataset", "model", "family", "run"]))


RUNS = ("runs AS (" + measures_sql(cells_sql("p", "dataset, model, family, run")) + "), "
        "base AS (" + measures_sql(cells_sql("p", "dataset, model, family, run", "baseline")) + ")")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of every measure per data set and model, rounded so that ties are ties everywhere."""
    mine = run_summary(runs(spark, sf_dir), ["dataset", "model", "family"])
    base = baseline_runs(spark, sf_dir).groupBy("dataset", "model", "family").agg(
        F.avg("f1").alias("baseline_f1_mean"))
    return rounded(mine.join(base, ["dataset", "model", "family"]), 6)


_M = ("accuracy", "precision", "recall", "f1", "error_rate")
SUMMARY = ("summary AS (SELECT a.*, round(b.f1, 6) AS baseline_f1_mean FROM (SELECT dataset, model, family, count(*) AS runs, "
           + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in _M) + ", "
           + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_total" for c in ("tp", "tn", "fp", "fn"))
           + " FROM runs GROUP BY dataset, model, family) a JOIN (SELECT dataset, model, family, avg(f1) AS f1 "
             "FROM base GROUP BY dataset, model, family) b USING (dataset, model, family))")


def with_runs(body: str, *ctes: str) -> str:
    return with_events(body, PREDICTIONS, RUNS, *ctes)


def with_summary(body: str, *ctes: str) -> str:
    return with_events(body, PREDICTIONS, RUNS, SUMMARY, *ctes)


REGIME = "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'standard' ELSE 'optimized' END"


def regime() -> Column:
    return F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'"), "standard").otherwise("optimized")
