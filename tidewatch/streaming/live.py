"""The live path: decode, score, route, publish, log.

All row logic is plain projections shared by stream and batch, so a static
table gives the same records. Progress lives in the query's checkpoint; what a
batch writes goes to a folder named by its number and overwrites it, so a
batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.portable import lenient_int, lenient_long
from ..functions.scalar import json_object, latency_ms, route
from ..operators.quality import batch_metrics, quarantine_reason
from ..operators.routing import Policy
from ..schema import BATCH_METRICS_DDL

ROUTED = ("message_id", "event_ts_ms", "processed_ts_ms", "e2e_latency_ms", "prediction", "label", "route",
          "source_topic", "source_partition", "source_offset", "consumer_lag")


def decode(messages: DataFrame, schema: T.StructType | str, value: str = "value") -> DataFrame:
    """Message text to columns; the envelope (topic, partition, offset) is kept, bad JSON gives nulls.

    The parsed struct is expanded by a generator, which keeps later filters
    above it: each message is parsed once, not once per field and condition.
    Time and label are read as text first, so "17" and "1.0" count as numbers.
    The message's own text stays as ``raw_value``.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lenient = {"event_ts_ms": lenient_long, "label": lenient_int}
    read = T.StructType([T.StructField(f.name, T.StringType() if f.name in lenient else f.dataType) for f in kind.fields])
    envelope = [c for c in messages.columns if c not in (*kind.fieldNames(), value)]
    rows = messages.select(*envelope, F.col(value).alias("raw_value"), F.inline(F.array(F.from_json(value, read))))
    return rows.withColumns({f.name: F.when(F.col(f.name).isNotNull(), lenient[f.name](f.name).cast(f.dataType))
                             for f in kind.fields if f.name in lenient})


def with_reason(records: DataFrame, required: list[str]) -> DataFrame:
    """Column ``reject_reason``: why a record goes to quarantine, null when it can be scored."""
    return records.withColumn("reject_reason", quarantine_reason(required))


def routed(records: DataFrame, score: Column, policy: Policy = Policy(), processed_ms: Column | None = None,
           lag: DataFrame | None = None) -> DataFrame:
    """The eleven fields of a routed record. The score is computed in place; a missing one counts as 0.0."""
    now = processed_ms if processed_ms is not None else F.unix_millis(F.current_timestamp())
    scored = records.withColumns({
        "prediction": F.coalesce(score, F.lit(0.0)), "event_ts_ms": lenient_long("event_ts_ms"),
        "label": lenient_int("label"), "processed_ts_ms": now.cast("bigint"),
        "source_topic": F.col("topic"), "source_partition": F.col("partition").cast("int"),
        "source_offset": F.col("offset").cast("bigint")})
    scored = scored.withColumns({
        "e2e_latency_ms": latency_ms("event_ts_ms", "processed_ts_ms"),
        "route": route("prediction", policy.anomaly_above, policy.normal_up_to, policy.topics)})
    if lag is not None:
        from ..operators.joins import attach_lag

        scored = attach_lag(scored, lag)
    else:
        scored = scored.withColumn("consumer_lag", F.lit(0).cast("bigint"))
    return scored.select(*ROUTED)


def as_messages(routed_rows: DataFrame) -> DataFrame:
    """Routed rows as ``topic, key, value`` for a topic sink."""
    return routed_rows.select(F.col("route").alias("topic"), F.col("message_id").alias("key"),
                              json_object({c: F.col(c) for c in ROUTED}).alias("value"))


def metrics_row(batch: DataFrame, started_ms: int, policy: Policy, model_name: str) -> DataFrame:
    """The metrics record of one batch."""
    lag = batch.groupBy("source_topic", "source_partition").agg(F.max("consumer_lag").alias("l"))
    text = F.format_string("(%s-%d,%d)", "source_topic", "source_partition", "l")
    lag = lag.agg(F.struct(F.sum("l").alias("total"), F.array_join(
        F.array_sort(F.collect_list(text)), ",").alias("text")).alias("s")).scalar()
    out = batch_metrics(batch, [], topics=policy.topics).withColumn("_lag", lag)
    done = F.lit(int(time.time() * 1000) - started_ms).cast("bigint")
    named = {"batch_start_ms": F.lit(started_ms).cast("bigint"), "batch_duration_ms": done,
             "total_consumer_lag": F.col("_lag.total"), "lag_by_partition": F.col("_lag.text"),
             "routing_policy": F.lit("route_uncertain" if policy.review_uncertain else "drop_uncertain"),
             "scoring_model": F.lit(model_name)}
    return out.withColumns(named).select(*T.StructType.fromDDL(BATCH_METRICS_DDL).fieldNames())


def batch_writer(out: str, score: Column | Callable[[DataFrame], DataFrame], required: list[str],
                 policy: Policy = Policy(), model_name: str = "random_forest_probability",
                 processed_ms: Column | None = None, lag: DataFrame | Callable[[int], DataFrame] | None = None,
                 sink: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What to do with one micro-batch: quarantine, route, publish, log. Empty batches are skipped.

    ``score`` is a column, or a function that adds a ``score`` column (a fitted
    pipeline's transform). ``lag`` is a table, or a function that gives the
    table of a batch. ``sink`` gets ``topic, key, value`` messages and the
    batch's number, such as ``kafka.publish``; by default routed records go to
    JSON files.
    """
    def to_files(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").partitionBy("route").json(f"{out}/routed/batch_id={batch_id}")


    def write(batch: DataFrame, batch_id: int) -> None:
        started = int(time.time() * 1000)
        held = with_reason(batch, required).persist()
        try:
            if held.isEmpty():
                return
            held.where(F.col("reject_reason").isNotNull()).write.mode("overwrite").json(
                f"{out}/quarantine/batch_id={batch_id}")
            valid = held.where(F.col("reject_reason").isNull())
            behind = lag(batch_id) if callable(lag) else lag
            if not isinstance(score, Column):
                rows = routed(score(valid), F.col("score"), policy, processed_ms, behind)
            else:
                rows = routed(valid, score, policy, processed_ms, behind)
            rows = rows.persist()
            try:
                if sink:
                    sink(as_messages(rows), batch_id)
                else:
                    to_files(rows, batch_id)
                metrics_row(rows, started, policy, model_name).write.mode("overwrite").json(
                    f"{out}/metrics/batch_id={batch_id}")
            finally:
                rows.unpersist()
        finally:
            held.unpersist()

    return write


def start(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str,
          interval: str | None = "10 seconds"):
    """Start the micro-batch loop; ``interval=None`` drains what is there and stops."""
    query = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True) if interval is None else query.trigger(processingTime=interval)
    return query.start()


def deduplicated(stream: DataFrame, ts: str, delay: str = "10 minutes", key: str = "message_id") -> DataFrame:
    """Drop replayed ids within the watermark; state is bounded by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(routed_rows: DataFrame, ts: str, width: str = "10 seconds",
                    topics: tuple[str, str, str] = ("anomaly", "normal", "uncertain")) -> DataFrame:
    """Event-time twin of the batch metrics: counts and mean latency per window.

    A stream must carry a watermark on ``ts`` already, as ``deduplicated`` sets it.
    """
    names = ("anomaly_count", "normal_count", "uncertain_count")
    return routed_rows.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("records_processed"), *[F.count_if(F.col("route") == t).alias(n) for n, t in zip(names, topics)],
        F.avg("e2e_latency_ms").alias("mean_e2e_latency_ms"))
