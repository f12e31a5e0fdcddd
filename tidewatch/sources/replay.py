"""Replay messages: two classes interleaved at their natural rate, numbered and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import json_object
from ..operators.ordered import ranked, with_range_bucket


def interleave(df: DataFrame, order: str, is_anomaly: Column, name: str = "seq") -> DataFrame:
    """Number the rows as ``r`` normals, one anomaly, ``r`` normals, ..., leftovers last.

    ``r`` is max(1, normals / anomalies). The final position has a closed form
    in the rank within the class, so no second global sort is needed.
    """
    marked = df.withColumn("_anom", is_anomaly.cast("int"))
    placed = ranked(with_range_bucket(marked, order), ["_anom"], [order], "_i")
    counts = marked.agg(F.struct(F.count_if(F.col("_anom") == 0).alias("normals"),
                                 F.count_if(F.col("_anom") == 1).alias("anomalies"))).scalar()
    i = F.col("_i") - 1
    normals, anomalies = F.col("_counts.normals"), F.col("_counts.anomalies")
    r = F.greatest(F.lit(1).cast("bigint"), F.expr("_counts.normals div greatest(1L, _counts.anomalies)"))
    block = F.floor(i / r).cast("bigint")
    at = F.when(F.col("_anom") == 0, i + F.least(anomalies, block)).otherwise(i + F.least(normals, (i + 1) * r))
    return (placed.withColumn("_counts", counts).withColumn(name, (at + 1).cast("bigint"))
            .drop("_anom", "_i", "_counts", "_bucket"))


def message_id(seq: str = "seq") -> Column:
    return F.format_string("msg-%08d", F.col(seq))


def replay_messages(df: DataFrame, order: str, is_anomaly: Column, fields: dict[str, Column],
                    start_ms: int, rate_ms: int, max_messages: int = 0) -> DataFrame:
    """``seq, message_id, event_ts_ms, payload``; times follow from the number and the pace."""
    numbered = interleave(df, order, is_anomaly)
    if max_messages > 0:
        numbered = numbered.where(F.col("seq") <= max_messages)
    timed = numbered.withColumns({"message_id": message_id(),
                                  "event_ts_ms": F.lit(start_ms) + (F.col("seq") - 1) * F.lit(rate_ms)})
    body = {"message_id": F.col("message_id"), "event_ts_ms": F.col("event_ts_ms"), **fields}
    return timed.withColumn("payload", json_object(body))
