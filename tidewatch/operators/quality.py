"""Message quality, recovery, alert timing and load of the live path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.portable import ratio
from ..shared import written
from .ordered import null_safe_join, quantiles, running, with_previous, with_range_bucket


def quarantine_reason(required: list[str], message_id: str = "message_id") -> Column:
    """Why a record cannot be scored; null for a valid one."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(True))
    return F.when(F.col(message_id).isNull(), "no_id").when(bad, "missing_feature")


def message_quality(df: DataFrame, order: str, ts: str, message_id: str, schema_ok: Column, nulls_ok: Column,
                    by: list[str] = ()) -> DataFrame:
    """Schema error rate, null record rate, duplicated ids and out-of-order records per group.

    A record is out of order when an earlier record of its group carries a
    later time; the running maximum is computed on two levels.
    """
    staged = df.select(order, *by, F.col(ts).alias("_ts"), F.col(message_id).alias("_id"),
                       (~schema_ok).alias("_bad"), (schema_ok & ~nulls_ok).alias("_null"))
    seen = running(with_range_bucket(staged, order), by, [order], {"_latest": ("max", F.col("_ts"))})
    rates = seen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("_bad").alias("schema_errors"),
        F.count_if("_null").alias("null_records"), F.count_if(F.col("_ts") < F.col("_latest")).alias("out_of_order"))
    copies = staged.where(F.col("_id").isNotNull()).groupBy(*by, "_id").agg(F.count(F.lit(1)).alias("_n"))
    copies = copies.groupBy(*by).agg(F.count_if(F.col("_n") > 1).alias("duplicated_ids"))
    both = (null_safe_join(rates, copies, by, "left") if by
            else rates.withColumn("duplicated_ids", copies.scalar()))
    return both.withColumns({"duplicated_ids": F.coalesce("duplicated_ids", F.lit(0)),
                             "schema_error_rate": ratio("schema_errors", "records"),
                             "null_error_rate": ratio("null_records", "records"),
                             "ordering_error_rate": ratio("out_of_order", "records")})


def recovery_time(df: DataFrame, by: list[str], ts: str, is_fault: Column, is_ok: Column) -> DataFrame:
    """First fault per group, first good record at or after it, and the gap in seconds."""
    starts = df.where(is_fault).groupBy(*by).agg(F.min(ts).alias("fault_start"))
    starts = written(starts, "faults")
    good = null_safe_join(df.where(is_ok), starts, by).where(F.col(ts) >= F.col("fault_start"))
    first = good.groupBy(*by).agg(F.min(ts).alias("first_ok"))
    return null_safe_join(starts, first, by, "left").withColumn(
        "recovery_seconds", (F.col("first_ok") - F.col("fault_start")).cast("double"))


def alert_timing(df: DataFrame, by: list[str], ts: str, label: str, route: str, scored: str, sent: str,
                 alert: str = "anomaly", uncertain: str = "uncertain") -> DataFrame:
    """Alert KPIs per group; times are seconds, ``scored`` and ``sent`` are times of the two later steps.

    The mean gap between alerts is (last - first) / (alerts - 1), so no window is needed.
    """
    alerts = F.count_if(F.col(route) == alert)
    at = F.when(F.col(route) == alert, F.col(ts))
    start = F.min(F.when(F.col(label) == 1, F.col(ts)))
    span = (F.max(ts) - F.min(ts)) / 60.0
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), alerts.alias("alerts"),
        (F.avg(F.col(scored) - F.col(ts)) * 1000).alias("detection_latency_ms"),
        (F.avg(F.col(sent) - F.col(scored)) * 1000).alias("publish_latency_ms"),
        (F.min(at) - start).alias("time_to_first_alert"), ratio(alerts, span).alias("alerts_per_minute"),
        F.try_divide(F.max(at) - F.min(at), alerts - 1).alias("mean_time_between_alerts"),
        ratio(alerts, F.count(F.lit(1))).alias("high_confidence_rate"),
        ratio(F.count_if(F.col(route) == uncertain), F.count(F.lit(1))).alias("uncertain_rate"),
        (F.max(ts) - F.min(at)).alias("lead_time"))


def alerts_per_shift(df: DataFrame, ts: str, route: str, alert: str = "anomaly", hours: int = 8) -> DataFrame:
    """Alerts per shift of the given length; ``ts`` in seconds."""
    shift = F.floor(F.col(ts) / (hours * 3600)).cast("bigint")
    return df.groupBy(shift.alias("shift")).agg(F.count_if(F.col(route) == alert).alias("alerts"),
                                                F.count(F.lit(1)).alias("records"))


def batch_metrics(routed: DataFrame, by: list[str], latency: str = "e2e_latency_ms", route: str = "route",
                  topics: tuple[str, str, str] = ("anomaly", "normal", "uncertain")) -> DataFrame:
    """Processed, per-route counts, mean and nearest-rank p95 latency per batch.

    Latencies are whole milliseconds, so one count by (batch, latency) answers
    everything; the table is read once.
    """
    names = ("anomaly_count", "normal_count", "uncertain_count")
    at = F.col(latency).cast("bigint")
    counts = routed.groupBy(*by, at.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), *[F.count_if(F.col(route) == t).alias(n) for n, t in zip(names, topics)])
    # Eight buckets for every doubling of the latency: a batch is spread without looking for cuts first.
    bucketed = counts.withColumn("_bucket", F.coalesce(F.floor(F.log2(F.greatest(F.col("_v"), F.lit(0)) + 1) * 8).cast("int"), F.lit(-1)))
    seen = F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)
    placed = running(bucketed, by, ["_v"], {"_upto": ("sum", seen)}, whole=True)
    rank = F.greatest(F.ceil(F.lit(0.95) * F.col("_upto_whole")), F.lit(1))
    whole = F.sum(F.col("_v") * F.col("_c")) / F.sum(seen)
    p95 = F.min(F.when((F.col("_upto") >= rank) & F.col("_v").isNotNull(), F.col("_v")))
    return placed.groupBy(*by).agg(F.sum("_c").alias("records_processed"), *[F.sum(n).alias(n) for n in names],
                                   F.round(whole, 4).alias("mean_e2e_latency_ms"), F.coalesce(p95, F.lit(0)).cast("bigint").alias("p95_e2e_latency_ms"))


def metrics_rollup(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Totals of a batch metrics log: record-weighted latency, q95 of the batch p95s, lag, duration, policies."""
    weighted = F.sum(F.col("mean_e2e_latency_ms") * F.col("records_processed"))
    base = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("records_processed").alias("records_processed"),
        F.sum("anomaly_count").alias("anomaly_count"), F.sum("normal_count").alias("normal_count"),
        F.sum("uncertain_count").alias("uncertain_count"),
        ratio(weighted, F.sum("records_processed")).alias("mean_e2e_latency_ms"),
        F.avg("total_consumer_lag").alias("mean_total_consumer_lag"),
        F.max("total_consumer_lag").alias("max_total_consumer_lag"),
        F.avg("batch_duration_ms").alias("mean_batch_duration_ms"),
        F.array_join(F.array_sort(F.collect_set("routing_policy")), ", ").alias("policy_names"))
    q95 = quantiles(log, by, "p95_e2e_latency_ms", {"p95_batch_e2e_latency_ms": 0.95})
    return (null_safe_join(base, q95, by, "left") if by
            else base.withColumn("p95_batch_e2e_latency_ms", q95.scalar()))


def replay_batches(spark, rate_ms: int, interval_s: int, duration_s: int, reservoir_rows: int) -> DataFrame:
    """Positions of a replay with their batch and the reservoir row they reuse cyclically.

    Positions beyond the last whole batch are dropped.
    """
    total = max(1, duration_s * 1000 // rate_ms)
    batches = max(1, duration_s // interval_s)
    at_ms = F.col("id") * rate_ms
    return (spark.range(total).where(at_ms < duration_s * 1000)
            .select(F.col("id").alias("position"), at_ms.alias("event_ms"),
                    F.expr(f"(id * {rate_ms}) div {interval_s * 1000}").alias("batch"),
                    F.pmod("id", F.lit(reservoir_rows)).alias("reservoir_row"))
            .where(F.col("batch") < batches))


def batch_load(log: DataFrame, by: list[str], batch: str, interval_s: float) -> DataFrame:
    """Load of a run of batches: rates, mean batch time and mean scheduling delay.

    A batch starts at its schedule or when the one before ends, whichever is
    later. With S the schedule and C the running work, batch i ends at
    C(i) + max over j <= i of (S(j) - C(j-1)): a running sum, then a running
    maximum. ``processing_s`` is the work of a batch, ``records`` its size.
    """
    timed = log.withColumn("_s", F.col(batch) * F.lit(float(interval_s)))
    summed = running(with_range_bucket(timed, batch), by, [batch], {"_c": ("sum", F.col("processing_s"))})
    summed = summed.withColumn("_gap", F.col("_s") - (F.col("_c") - F.col("processing_s")))
    ended = running(summed, by, [batch], {"_lead": ("max", F.col("_gap"))})
    delay = F.col("_lead") + F.col("_c") - F.col("processing_s") - F.col("_s")
    busy = F.sum("processing_s")
    return ended.groupBy(*by).agg(
        F.count(F.lit(1)).alias("batch_count"), F.sum("records").alias("messages"),
        ratio(F.sum("records"), F.count(F.lit(1)) * F.lit(float(interval_s))).alias("avg_input_s"),
        ratio(F.sum("records"), busy).alias("avg_process_s"), (F.avg("processing_s") * 1000).alias("mean_batch_ms"),
        (F.avg(delay) * 1000).alias("mean_delay_ms"))


def delay_matrix(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Mean value by row and column, listed columns only, missing cells 0.0."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return wide.fillna(0.0, [str(c) for c in columns])


def monotonic_steps(df: DataFrame, order: str, ts: str, by: list[str] = ()) -> DataFrame:
    """Rows whose time lies before the row just above, per group."""
    stepped = with_previous(with_range_bucket(df.select(order, ts, *by), order), by, order, {"_before": ts})
    return stepped.groupBy(*by).agg(F.count(F.lit(1)).alias("records"),
                                    F.count_if(F.col(ts) < F.col("_before")).alias("steps_back"))
