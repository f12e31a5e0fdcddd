"""Streaming jobs over the given event table, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import uniform
from ..functions.scalar import json_object
from ..operators.quality import batch_metrics
from ..operators import joins
from ..operators.quality import message_quality
from ..shared import run_dir
from ..sources import tablelog
from ..streaming import live, reconcile
from .registry import query
from .views import EPOCH_MS, ROUTE, events, rounded, table, u_sql, with_events

MESSAGE = "message_id STRING, event_ts_ms BIGINT, label INT, value DOUBLE, score DOUBLE"
EVENT_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DONE_MS = EPOCH_MS + 31 * 86400000


def _as_messages(raw):
    """Event rows as bus messages: one in a hundred has no id, readings of the first hour of day are missing."""
    u = uniform(42, "event_id")
    label = (F.col("event_type") == "error").cast("int")
    body = json_object({
        "message_id": F.when(uniform(97, "event_id") >= 0.01, F.concat(F.lit("m"), F.col("event_id").cast("string"))),
        "event_ts_ms": F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"),
        "label": label, "value": F.when(F.hour("ts") != 0, F.col("value")),
        "score": F.least(F.lit(1.0), F.lit(0.6) * u + F.lit(0.4) * label)})
    return raw.select(F.lit("input").alias("topic"), F.pmod("event_id", F.lit(4)).cast("int").alias("partition"),
                      F.col("event_id").alias("offset"), body.alias("value"))


def _stream(spark, sf):
    return spark.readStream.schema(EVENT_DDL).option("pathGlobFilter", "events.parquet").parquet(sf)


#: Arrivals, each a micro-batch.
FILES = 4


def _arrivals(spark, sf):
    """The events in several parts, each to be a micro-batch."""
    rows = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return [rows.where(F.pmod(F.floor(F.col("event_id") / 4), F.lit(FILES)) == k) for k in range(FILES)]


def _arriving(spark, path, part):
    """The stream of a folder after a part has arrived there, in as many files as it has tasks. A run over all there is takes what
    is new as one micro-batch."""
    part.write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT_DDL).parquet(path)


def _drain(spark, sf, name, rounds=1, arrivals=None, score=None, **more):
    """Run the live job over everything there is, a number of times on one progress folder; returns the output folder. With
    ``arrivals`` the first of these times is a run after each of them."""
    out = run_dir(spark, name)
    write = live.batch_writer(out, F.col("score") if score is None else score, ["value"], processed_ms=F.lit(DONE_MS).cast("bigint"), **more)

    def run(stream):
        live.start(live.decode(_as_messages(stream), MESSAGE), write, f"{out}/progress", interval=None).awaitTermination()

    if arrivals is None:
        stream = _stream(spark, sf)
        run(stream)
    else:
        path = run_dir(spark, "arriving")
        for part in arrivals:
            stream = _arriving(spark, path, part)
            run(stream)
    for _ in range(rounds - 1):
        run(stream)
    return out


VALID = f"""ok AS (SELECT *, {ROUTE} AS route, ts_us // 1000 AS ms FROM e WHERE {u_sql('97', 'event_id')} >= 0.01 AND hr <> 0)"""
ROUTED_SQL = f"""SELECT 'm' || event_id AS message_id, ms AS event_ts_ms, {DONE_MS}::BIGINT AS processed_ts_ms, {DONE_MS}::BIGINT - ms AS e2e_latency_ms,
 round(score, 6) AS prediction, label, route, 'input' AS source_topic, CAST(event_id % 4 AS INTEGER) AS source_partition, event_id AS source_offset,
 0::BIGINT AS consumer_lag FROM ok"""


@query("st02_decode_score_route", with_events(ROUTED_SQL, VALID))
def decode_score_route(spark, sf):
    records = live.with_reason(live.decode(_as_messages(table(spark, sf, "events")), MESSAGE), ["value"])
    valid = records.where(F.col("reject_reason").isNull())
    return rounded(live.routed(valid, F.col("score"), processed_ms=F.lit(DONE_MS)))


@query("st03_live_routed_records", with_events(ROUTED_SQL, VALID))
def live_routed(spark, sf):
    out = _drain(spark, sf, "live")
    from ..schema import ROUTED_DDL

    return rounded(spark.read.schema(ROUTED_DDL).json(f"{out}/routed").select(*live.ROUTED))


@query("st01_micro_batch_loop", with_events(f"SELECT {FILES}::BIGINT AS batches, count(*) AS records FROM ok", VALID))
def micro_batch_loop(spark, sf):
    """Drain a stream of several micro-batches, then trigger once more: an empty round leaves no batch behind."""
    out = _drain(spark, sf, "loop", rounds=2, arrivals=_arrivals(spark, sf))
    return spark.read.schema("records_processed BIGINT").json(f"{out}/metrics").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("records_processed").alias("records"))


@query("snk05_streaming_topic_sink", with_events("""
SELECT route AS topic, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS offsets FROM ok GROUP BY 1""", VALID))
def streaming_topic_sink(spark, sf):
    """Routed messages straight from the stream into one folder per topic."""
    out = run_dir(spark, "topics")
    records = live.with_reason(live.decode(_as_messages(_stream(spark, sf)), MESSAGE), ["value"]).where("reject_reason IS NULL")
    messages = live.as_messages(live.routed(records, F.col("score"), processed_ms=F.lit(DONE_MS)))
    (messages.writeStream.format("json").partitionBy("topic").option("path", f"{out}/rows")
     .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination())
    back = spark.read.schema("topic STRING, key STRING, value STRING").json(f"{out}/rows")
    return back.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(
        F.get_json_object("value", "$.source_offset").cast("bigint")).alias("offsets"))


@query("st04_live_batch_metrics", with_events(f"""
SELECT event_id // 4 % {FILES} AS batch, count(*) AS records_processed, count(*) FILTER (route = 'anomaly') AS anomaly_count, count(*) FILTER (route = 'normal') AS normal_count,
 count(*) FILTER (route = 'uncertain') AS uncertain_count, round(avg({DONE_MS} - ms), 2) AS mean_e2e_latency_ms,
 CAST(quantile_disc({DONE_MS} - ms, 0.95) AS BIGINT) AS p95_e2e_latency_ms, (6 + 40 * ({FILES} - 1 - event_id // 4 % {FILES}))::BIGINT AS total_consumer_lag, 'route_uncertain' AS routing_policy FROM ok GROUP BY event_id // 4 % {FILES}""", VALID))
def live_metrics(spark, sf):
    from ..schema import BATCH_METRICS_DDL

    def lag(batch):
        return spark.range(4).select(F.lit("input").alias("topic"), F.col("id").cast("int").alias("partition"),
                                     (F.col("id") + 10 * (FILES - 1 - batch)).alias("consumer_lag"))

    out = _drain(spark, sf, "metrics", arrivals=_arrivals(spark, sf), lag=lag)
    log = spark.read.schema(BATCH_METRICS_DDL + ", batch_id BIGINT").json(f"{out}/metrics")
    return log.select(F.col("batch_id").alias("batch"), "records_processed", "anomaly_count", "normal_count", "uncertain_count", F.round("mean_e2e_latency_ms", 2).alias("mean_e2e_latency_ms"),
                      "p95_e2e_latency_ms", "total_consumer_lag", "routing_policy")


@query("st10_quarantine", with_events(f"""
SELECT event_id AS source_offset, CASE WHEN hr <> 0 THEN value END IS NULL AS value_missing_in_text, CASE WHEN {u_sql('97', 'event_id')} < 0.01 THEN 'no_id' ELSE 'missing_feature' END AS reject_reason
FROM e WHERE {u_sql('97', 'event_id')} < 0.01 OR hr = 0"""))
def quarantine(spark, sf):
    out = _drain(spark, sf, "quarantine")
    return spark.read.schema("offset BIGINT, reject_reason STRING, raw_value STRING").json(f"{out}/quarantine").select(
        F.col("offset").alias("source_offset"), F.col("raw_value").contains('"value":null').alias("value_missing_in_text"), "reject_reason")


@query("st05_restart_from_progress", with_events("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM ok", VALID))
def restart(spark, sf):
    """The same job started twice on one progress folder delivers every record once."""
    out = _drain(spark, sf, "restart", rounds=2)
    back = spark.read.schema("message_id STRING").json(f"{out}/routed")
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message_id").alias("ids"))


@query("st04_event_time_windows", with_events(f"""
SELECT make_timestamp((ts_us // 10000000) * 10000000) AS window_start, count(*) AS records_processed, count(*) FILTER (route = 'anomaly') AS anomaly_count,
 count(*) FILTER (route = 'normal') AS normal_count, count(*) FILTER (route = 'uncertain') AS uncertain_count FROM (SELECT *, {ROUTE} AS route FROM e) GROUP BY 1"""))
def event_time_windows(spark, sf):
    from ..functions.scalar import route

    e = events(spark, sf).select("ts", F.lit(0).alias("e2e_latency_ms"), route("score").alias("route"))
    out = live.windowed_counts(e, "ts")
    return out.select(F.col("w.start").alias("window_start"), "records_processed", "anomaly_count", "normal_count", "uncertain_count")


@query("st_event_time_windows_streamed", with_events(f"""
SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS records FROM (SELECT ms // 10000 AS w, count(*) AS n FROM
 (SELECT ts_us // 1000 AS ms FROM e WHERE {u_sql('97', 'event_id')} >= 0.01) GROUP BY 1)"""))
def event_time_windows_streamed(spark, sf):
    """Streaming run of the windowed counts over deduplicated ids. A last record two days later moves the watermark past
    every window, so all are final; its own window stays open."""
    from ..functions.scalar import route

    out = run_dir(spark, "windows")
    e = table(spark, sf, "events")
    last = e.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), (F.max("event_id") + 1).alias("event_id")).select(
        "event_id", "ts", F.lit(0).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("end").alias("props"))
    # All events are one arrival: in several, those behind the watermark of the earlier ones would be late.
    path = run_dir(spark, "ending")
    for part in (e.select(*last.columns), last):
        stamped = live.decode(_as_messages(_arriving(spark, path, part)), MESSAGE)
        records = stamped.where(F.col("message_id").isNotNull()).withColumn("at", F.timestamp_millis("event_ts_ms"))
        rows = live.deduplicated(records, "at").withColumns({"e2e_latency_ms": F.lit(0), "route": route("score")})
        counted = live.windowed_counts(rows, "at").drop("w")
        run = (counted.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows")
               .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start())
        run.awaitTermination()
    return spark.read.schema("records_processed BIGINT").parquet(f"{out}/rows").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("records_processed").alias("records"))


@query("st03_live_saved_model", with_events("SELECT count(*) AS records, 0::BIGINT AS routed_otherwise FROM ok", VALID))
def live_saved_model(spark, sf):
    """The stream scored by a saved pipeline, beside the same pipeline on the static table."""
    from ..operators import models
    from ..schema import ROUTED_DDL

    path = run_dir(spark, "scorer")
    models.save(models.fit("decision_tree", events(spark, sf).select("label", "value"), ["value"], "label"), path, ["value"], "label")
    fitted = models.load(path)
    out = _drain(spark, sf, "scored", arrivals=_arrivals(spark, sf), score=lambda df: models.with_scores(fitted, df.drop("score")))
    flowed = spark.read.schema(ROUTED_DDL).json(f"{out}/routed").select("message_id", "route")
    records = live.with_reason(live.decode(_as_messages(table(spark, sf, "events")), MESSAGE), ["value"]).where("reject_reason IS NULL")
    still = live.routed(models.with_scores(fitted, records.drop("score")), F.col("score"), processed_ms=F.lit(DONE_MS))
    both = flowed.join(still.select("message_id", F.col("route").alias("expected")), "message_id", "full")
    return both.agg(F.count("route").alias("records"), F.count_if(~F.col("route").eqNullSafe(F.col("expected"))).alias("routed_otherwise"))


@query("snk06_metrics_append", with_events("SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS records FROM (SELECT count(*) AS n FROM e GROUP BY ts_us // 3600000000)"))
def metrics_append(spark, sf):
    """Metrics records of hourly batches, appended as JSON lines in two writes."""
    from .aggregates import latencies

    path = run_dir(spark, "metricslog")
    rows = batch_metrics(latencies(spark, sf), ["batch"])
    rows.where("anomaly_count = 0").write.mode("append").json(path)
    rows.where("anomaly_count > 0").write.mode("append").json(path)
    return spark.read.schema("records_processed BIGINT").json(path).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("records_processed").alias("records"))


def _logged(spark, sf):
    """Events as log messages: four partitions by event id, offsets without gaps."""
    raw = _as_messages(table(spark, sf, "events")).withColumn("offset", F.expr("offset div 4"))
    return raw.select("partition", "offset", F.get_json_object("value", "$.message_id").alias("key"), "value")


def _kept(stream, out):
    """A stream's rows as files."""
    return stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress")


@query("src05_subscribe_at_latest", with_events("""
SELECT CAST(event_id % 4 AS INTEGER) AS partition, count(*) AS n, min(event_id // 4) AS first_offset, max(event_id // 4) AS last_offset FROM e, (SELECT max(event_id) // 8 AS half FROM e)
WHERE event_id // 4 >= half GROUP BY 1"""))
def subscribe_at_latest(spark, sf):
    """A subscription that starts at the latest offset sees only what is appended after."""
    out, log = run_dir(spark, "latest"), run_dir(spark, "log")
    rows = _logged(spark, sf)
    half = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 8
    tablelog.append(rows.where(F.col("offset") < half), log)
    running = _kept(tablelog.subscribe(spark, log), out).trigger(processingTime="0 seconds").start()
    try:
        running.processAllAvailable()
        tablelog.append(rows.where(F.col("offset") >= half), log)
        running.processAllAvailable()
    finally:
        running.stop()
    back = spark.read.schema(tablelog.SCHEMA).parquet(f"{out}/rows")
    return back.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query("src05_subscribe_at_offsets", with_events(f"""
SELECT CAST(event_id % 4 AS INTEGER) AS partition, count(*) AS n, count(DISTINCT event_id) AS offsets, CAST(sum(event_id) AS BIGINT) AS ids, {FILES}::BIGINT AS batches
FROM e WHERE event_id // 4 >= 10 * (1 + event_id % 4) GROUP BY 1"""))
def subscribe_at_offsets(spark, sf):
    """Given offsets, a limit per trigger, and a new start after every batch: each message once."""
    out, log = run_dir(spark, "offsets"), run_dir(spark, "log")
    tablelog.append(_logged(spark, sf), log)
    limit = -(-4 * (max(tablelog.end_offsets(log).values()) - 10) // FILES) + 4
    for _ in range(FILES + 1):
        stream = tablelog.subscribe(spark, log, starting='{"0": 10, "1": 20, "2": 30, "3": 40}', max_per_trigger=limit, progress=f"{out}/progress")
        _kept(stream, out).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema(tablelog.SCHEMA).parquet(f"{out}/rows")
    batches = spark.read.text(f"{out}/progress/commits").select(F.input_file_name().alias("f")).agg(F.countDistinct("f").alias("b")).scalar()
    return back.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("offsets"),
                                         F.sum(F.col("offset") * 4 + F.col("partition")).alias("ids")).withColumn("batches", batches)


@query("st06_live_lag", with_events(f"""
SELECT batch, CAST(count(*) AS BIGINT) AS records_processed, any_value(lag) AS total_consumer_lag FROM (
 SELECT event_id // 4 // size AS batch, sum(greatest(0, n - (event_id // 4 // size + 1) * size)) OVER (PARTITION BY event_id // 4 // size) AS s, n, size, event_id FROM ok
 JOIN (SELECT event_id % 4 AS p, max(event_id) // 4 + 1 AS n FROM e GROUP BY 1) ON p = event_id % 4, (SELECT (max(event_id) // 4 + 1 + {FILES - 1}) // {FILES} AS size FROM e))
 JOIN (SELECT b AS batch, CAST(sum(greatest(0, n - (b + 1) * size)) AS BIGINT) AS lag FROM range({FILES}) r(b), (SELECT event_id % 4 AS p, max(event_id) // 4 + 1 AS n FROM e GROUP BY 1),
 (SELECT (max(event_id) // 4 + 1 + {FILES - 1}) // {FILES} AS size FROM e) GROUP BY b) USING (batch) GROUP BY batch""", VALID))
def live_lag(spark, sf):
    """Lag of every batch from the running query's own offset log and the log's ends; each run takes what its limit allows."""
    out, log = run_dir(spark, "lag"), run_dir(spark, "log")
    tablelog.append(_logged(spark, sf), log)
    size = -(-max(tablelog.end_offsets(log).values()) // FILES)
    behind = reconcile.progress_lag(spark, f"{out}/progress", lambda: {"input": tablelog.end_offsets(log)})
    write = live.batch_writer(out, F.col("score"), ["value"], processed_ms=F.lit(DONE_MS).cast("bigint"), lag=behind)
    for _ in range(FILES):
        stream = tablelog.subscribe(spark, log, starting="earliest", max_per_trigger=4 * size, progress=f"{out}/progress")
        live.start(live.decode(stream.drop("key"), MESSAGE), write, f"{out}/progress", interval=None).awaitTermination()
    return spark.read.schema("batch_id BIGINT, records_processed BIGINT, total_consumer_lag BIGINT").json(f"{out}/metrics").select(
        F.col("batch_id").alias("batch"), "records_processed", "total_consumer_lag")


def _sides(e):
    """What was sent and what arrived of it: one in twenty is lost, the rest arrives within half an hour."""
    rows = e.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    sent = rows.select("id", "at", F.lit("input").alias("expected"))
    late = F.floor(uniform("late", "event_id") * 1800).cast("int")
    got = rows.where(uniform("lost", "event_id") >= 0.05).select("id", (F.col("at") + F.make_dt_interval(secs=late)).alias("at"), F.lit("input").alias("actual"))
    return sent, got


LOST = f"""SELECT count(*) AS messages, count(*) FILTER ({u_sql('lost', 'event_id')} < 0.05) AS lost, CAST(sum(event_id) FILTER ({u_sql('lost', 'event_id')} < 0.05) AS BIGINT) AS lost_ids FROM e"""


@query("jn14_delivery_reconciled_streamed", with_events(LOST))
def delivery_streamed(spark, sf):
    """Stream-stream reconciliation: a lost message comes out once, when the watermarks have passed its hour. A last message two days
    later on both sides moves them past everything; it stays open itself."""
    out, path = run_dir(spark, "reconciled"), run_dir(spark, "sides")
    e = table(spark, sf, "events").select("event_id", "ts")
    sent, got = _sides(e)
    end = e.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).cast("timestamp").alias("at"))
    first = (sent, got), (end.select(F.lit("end").alias("id"), "at", F.lit("input").alias("expected")), end.select(F.lit("end").alias("id"), "at", F.lit("input").alias("actual")))
    for a, b in first:
        a.write.mode("append").parquet(f"{path}/sent")
        b.write.mode("append").parquet(f"{path}/delivered")
        streams = (spark.readStream.schema(f.schema).parquet(f"{path}/{name}") for f, name in ((sent, "sent"), (got, "delivered")))
        rows = reconcile.reconciled(*streams, "id", "at", "at")
        _kept(rows, out).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("key STRING, lost BOOLEAN").parquet(f"{out}/rows").where("key != 'end'")
    return back.agg(F.count(F.lit(1)).alias("messages"), F.count_if("lost").alias("lost"), F.sum(F.when(F.col("lost"), F.substring("key", 2, 20).cast("bigint"))).alias("lost_ids"))


@query("jn14_delivery_reconciled", with_events(LOST))
def delivery_reconciled(spark, sf):
    """The same reconciliation on tables."""
    sent, got = _sides(table(spark, sf, "events").select("event_id", "ts"))
    out = joins.spread_join(sent, got.groupBy("id").agg(F.max("actual").alias("actual")), "id", "left")
    lost = F.col("actual").isNull()
    return out.agg(F.count(F.lit(1)).alias("messages"), F.count_if(lost).alias("lost"), F.sum(F.when(lost, F.substring("id", 2, 20).cast("bigint"))).alias("lost_ids"))


def _quality_rows(e):
    """Messages by source partition: a twentieth share an id with others far away, a tenth carry a time an hour back."""
    offset = F.expr("event_id div 4")
    mid = F.when(uniform("d", "event_id") < 0.05, offset % 500).otherwise(offset + 1000000000).cast("string")
    late = F.when(uniform("o", "event_id") < 0.1, 3600000000).otherwise(0)
    return e.select(F.pmod("event_id", F.lit(4)).cast("int").alias("partition"), offset.alias("offset"), mid.alias("message_id"),
                    (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") - late).alias("event_ts_ms"))


QUALITY = f"""q AS (SELECT CAST(event_id % 4 AS INTEGER) AS partition, event_id // 4 AS o, CASE WHEN {u_sql('d', 'event_id')} < 0.05 THEN event_id // 4 % 500 ELSE event_id // 4 + 1000000000 END AS mid,
 ts_us - CASE WHEN {u_sql('o', 'event_id')} < 0.1 THEN 3600000000 ELSE 0 END AS t FROM e)"""
QUALITY_SQL = """SELECT partition, records, out_of_order, dup AS duplicated_ids FROM (SELECT partition, count(*) AS records, count(*) FILTER (t < latest) AS out_of_order FROM (
 SELECT *, max(t) OVER (PARTITION BY partition ORDER BY o) AS latest FROM q) GROUP BY partition) JOIN (SELECT partition, count(*) FILTER (n > 1) AS dup FROM (
 SELECT partition, mid, count(*) AS n FROM q GROUP BY ALL) GROUP BY partition) USING (partition)"""


@query("ag34_message_quality_by_partition", with_events(QUALITY_SQL, QUALITY))
def quality_by_partition(spark, sf):
    rows = _quality_rows(table(spark, sf, "events"))
    out = message_quality(rows, "offset", "event_ts_ms", "message_id", F.lit(True), F.lit(True), ["partition"])
    return out.select("partition", "records", "out_of_order", "duplicated_ids")


@query("ag34_message_quality_streamed", with_events(QUALITY_SQL, QUALITY))
def quality_streamed(spark, sf):
    """The same rates from state kept across micro-batches: late times and copied ids that straddle batches count."""
    out, log = run_dir(spark, "flags"), run_dir(spark, "log")
    rows = _quality_rows(table(spark, sf, "events"))
    tablelog.append(rows.select("partition", "offset", F.col("message_id").alias("key"), F.col("event_ts_ms").cast("string").alias("value")), log)
    limit = 4 * -(-max(tablelog.end_offsets(log).values()) // FILES)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in range(FILES):
            stream = tablelog.subscribe(spark, log, starting="earliest", max_per_trigger=limit, progress=f"{out}/progress")
            _kept(reconcile.ordered_flags(stream, "key", "value"), out).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return spark.read.schema(reconcile.FLAGS).parquet(f"{out}/rows").groupBy("partition").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("late").alias("out_of_order"), F.count_if("second").alias("duplicated_ids"))
