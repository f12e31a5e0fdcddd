"""Readers and writers: every file format is written from a given table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import lenient_int
from ..functions.scalar import json_object
from ..shared import run_dir
from ..sources import readers, writers
from ..sources.replay import replay_messages
from ..schema import LABEL, TIMESTAMP
from .registry import query
from .views import EPOCH_MS, ROUTE, events, regime, REGIME, summaries, table, with_events, with_summary


@query("src01_csv_scan", "SELECT event_id, event_type, value FROM events")
def csv_scan(spark, sf):
    path = run_dir(spark, "csv")
    writers.write_csv(table(spark, sf, "events").select("event_id", "event_type", "value"), path)
    return readers.read_csv(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")


@query("src02_typed_loader", with_events("""
SELECT event_id, coalesce(CASE WHEN hr <> 0 THEN ts_s END, (row_number() OVER (ORDER BY event_id) - 1)::DOUBLE) AS "Timestamp",
 label AS "Labels", value, k::DOUBLE AS k FROM e"""))
def typed_loader(spark, sf):
    path = run_dir(spark, "labelled")
    e = events(spark, sf)
    raw = e.select("event_id", F.when(F.col("hr") != 0, F.col("ts_s")).alias(TIMESTAMP),
                   F.col("label").cast("double").alias(LABEL), "value", "k")
    writers.write_csv(raw, path)
    return readers.load_labelled(spark, path, order="event_id").select("event_id", TIMESTAMP, LABEL, "value", "k")


LABEL_TEXT = {"error": "1", "click": "1.0", "view": "0", "purchase": "x", "signup": ""}


@query("src03_label_filtered_scan", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click')")
def label_filtered(spark, sf):
    t = table(spark, sf, "events")
    text = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in LABEL_TEXT.items()])
    return readers.with_label(t.withColumn("flag", text), 1, "flag").select("event_id", "event_type")


@query("src06_json_decode", with_events("SELECT event_id, k FROM e"))
def json_decode(spark, sf):
    return readers.decode_json(table(spark, sf, "events"), "props", "k INT").select("event_id", F.col("body.k").alias("k"))


@query("src07_json_lines_tolerant", with_events("SELECT event_id, value FROM e WHERE event_type NOT IN ('error', 'view')"))
def json_lines(spark, sf):
    path = run_dir(spark, "lines")
    good = json_object({"event_id": F.col("event_id"), "value": F.col("value")})
    line = (F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("event_id").cast("string")))
            .when(F.col("event_type") == "view", F.lit("")).otherwise(good))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.read_json_lines(spark, path, "event_id BIGINT, value DOUBLE")


@query("src09_report_scan", with_summary("SELECT dataset, model, f1_mean FROM summary WHERE family <> 'f0'"))
def report_scan(spark, sf):
    root = run_dir(spark, "reports")
    named = summaries(spark, sf).withColumn("name", F.when(F.col("family") != "f0", F.col("model")))
    (named.select(F.col("dataset").alias("folder"), "dataset", F.col("name").alias("model"), "f1_mean")
     .write.partitionBy("folder").json(root))
    return readers.read_reports(spark, root, "dataset STRING, model STRING, f1_mean DOUBLE", multi_line=False).drop("source_file")


@query("src10_summary_csv", with_summary("""
SELECT dataset, model, f1_mean, CASE WHEN family <> 'f0' THEN recall_mean END AS recall_mean FROM summary"""))
def summary_csv(spark, sf):
    path = run_dir(spark, "summary")
    s = summaries(spark, sf)
    text = F.when(F.col("family") != "f0", F.col("recall_mean").cast("string")).otherwise("N/A")
    writers.write_csv(s.select("dataset", "model", "f1_mean", text.alias("recall_mean")), path)
    return readers.read_summary_csv(spark, path, ["f1_mean", "recall_mean"])


REPLAY = """
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS i FROM e),
c AS (SELECT count(*) FILTER (label = 0) AS nn, count(*) FILTER (label = 1) AS na FROM e),
o AS (SELECT n.*, row_number() OVER (ORDER BY CASE WHEN label = 0 THEN i // greatest(1, nn // greatest(1, na)) ELSE i END,
 label, i) AS seq FROM n, c)"""


@query("src12_replay", with_events(f"""
SELECT seq, printf('msg-%08d', seq) AS message_id, {EPOCH_MS} + (seq - 1) * 10 AS event_ts_ms, event_id, label,
 value AS payload_value FROM o""", REPLAY))
def replay(spark, sf):
    e = events(spark, sf)
    sent = replay_messages(e, "event_id", F.col("label") == 1,
                           {"label": F.col("label"), "value": F.col("value")}, EPOCH_MS, 10)
    value = F.from_json("payload", "value DOUBLE")["value"]
    return sent.select("seq", "message_id", "event_ts_ms", "event_id", "label", value.alias("payload_value"))


@query("snk01_csv_write", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def csv_write(spark, sf):
    path = run_dir(spark, "csvout")
    writers.write_csv(table(spark, sf, "events").select("event_type", "value"), path)
    back = readers.read_csv(spark, path, "event_type STRING, value DOUBLE")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("snk02_single_file_csv", "SELECT event_type, count(*) AS n, 1::BIGINT AS files FROM events GROUP BY 1")
def single_file(spark, sf):
    path = run_dir(spark, "single")
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    writers.write_csv(counts, path, mode="overwrite", single_file=True)
    back = readers.read_csv(spark, path, "event_type STRING, n BIGINT").withColumn("file", F.col("_metadata.file_name"))
    return back.withColumn("files", back.agg(F.countDistinct("file")).scalar()).drop("file")


@query("snk03_dataset_layout", with_events("""
SELECT (row_number() OVER (ORDER BY event_id) - 1)::DOUBLE AS "Timestamp", label AS "Labels", value, k::DOUBLE AS k FROM e"""))
def dataset_layout(spark, sf):
    e = events(spark, sf).select("event_id", F.col("label").alias(LABEL), "value", "k")
    return writers.dataset_layout(e, ["value", "k"], order="event_id")


ROUTED_BACK = with_events(f"SELECT topic, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, {ROUTE} AS topic FROM e) GROUP BY 1")


@query("snk04_routed_sink", ROUTED_BACK)
def routed_sink(spark, sf):
    from ..operators.routing import with_route

    path = run_dir(spark, "routed")
    rows = with_route(events(spark, sf).select("event_id", "score"))
    body = json_object({"event_id": F.col("event_id")})
    writers.write_routed(writers.routed_messages(rows, "route", F.col("event_id"), body), path)
    back = spark.read.schema("topic STRING, key STRING, value STRING").json(path)
    return back.groupBy("topic").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.get_json_object("value", "$.event_id").cast("bigint")).alias("ids"))


@query("snk07_union_of_columns", with_events("""
SELECT user_id, label, value, CAST(NULL AS DOUBLE) AS k FROM e WHERE label = 0 UNION ALL
SELECT user_id, label, CAST(NULL AS DOUBLE), k::DOUBLE FROM e WHERE label = 1"""))
def union_of_columns(spark, sf):
    e = events(spark, sf)
    a, b = e.where("label = 0").select("value", "label", "user_id"), e.where("label = 1").select(
        F.col("k").cast("double").alias("k"), "user_id", "label")
    path = run_dir(spark, "ragged")
    writers.write_report([a, b], path, preferred=["user_id", "label"])
    return spark.read.schema("user_id BIGINT, label INT, value DOUBLE, k DOUBLE").json(path)


@query("snk10_split_snapshots", with_events(f"""
SELECT {REGIME} AS scenario, CASE WHEN label = 1 THEN 'test_raw' ELSE 'train_raw' END AS split, count(*) AS n,
 round(sum(value), 4) AS total FROM e GROUP BY 1, 2"""))
def snapshots(spark, sf):
    e = events(spark, sf).withColumn("regime", regime()).select("event_id", "value", "label", "regime")
    path = run_dir(spark, "snapshots")
    parts = {(r, s): e.where((F.col("regime") == r) & (F.col("label") == v)).drop("regime", "label")
             for r in ("standard", "optimized") for s, v in (("train_raw", 0), ("test_raw", 1))}
    writers.write_snapshots(parts, path)
    return spark.read.parquet(path).groupBy("scenario", "split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("sc15_lenient_casts", """
SELECT event_id, CASE WHEN event_type = 'view' THEN -1 ELSE CAST(trunc(value) AS INTEGER) END AS as_int,
 CASE WHEN event_type = 'view' THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS as_long FROM events""")
def lenient_casts(spark, sf):
    from ..functions.portable import lenient_long

    text = F.when(F.col("event_type") == "view", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    t = table(spark, sf, "events").withColumn("text", text)
    return t.select("event_id", lenient_int("text").alias("as_int"), lenient_long("text").alias("as_long"))
