"""Declared schemas of the sensor, message and report tables."""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMP, LABEL = "Timestamp", "Labels"

# Subsystems and the three channels each one reports, in column order.
SUBSYSTEMS = ("BLO", "BHL", "BHR", "BRU", "HR", "HL")
CHANNELS = ("I_w_{}_Weg", "O_w_{}_power", "O_w_{}_voltage")
FEATURES = tuple(c.format(s) for s in SUBSYSTEMS for c in CHANNELS)

# Names under which a label column may arrive.
LABEL_CANDIDATES = ("Labels", "label", "Label", "class", "target", "y")


def sensor_schema(features=FEATURES) -> T.StructType:
    return T.StructType([T.StructField(TIMESTAMP, T.DoubleType()), T.StructField(LABEL, T.IntegerType()),
                         *[T.StructField(f, T.DoubleType()) for f in features]])


def message_schema(features=FEATURES) -> T.StructType:
    """Incoming stream message."""
    head = [("message_id", T.StringType()), ("event_ts_ms", T.LongType()), ("source_timestamp", T.DoubleType()),
            ("label", T.IntegerType()), ("source_dataset", T.StringType())]
    return T.StructType([*[T.StructField(n, t) for n, t in head],
                         *[T.StructField(f, T.DoubleType()) for f in features]])


# Field names and order of the routed message and of the batch metrics record.
ROUTED_DDL = ("message_id STRING, event_ts_ms BIGINT, processed_ts_ms BIGINT, e2e_latency_ms BIGINT, "
              "prediction DOUBLE, label INT, route STRING, source_topic STRING, source_partition INT, "
              "source_offset BIGINT, consumer_lag BIGINT")
BATCH_METRICS_DDL = ("batch_start_ms BIGINT, batch_duration_ms BIGINT, records_processed BIGINT, "
                     "anomaly_count BIGINT, normal_count BIGINT, uncertain_count BIGINT, "
                     "mean_e2e_latency_ms DOUBLE, p95_e2e_latency_ms BIGINT, total_consumer_lag BIGINT, "
                     "lag_by_partition STRING, routing_policy STRING, scoring_model STRING")
# Columns of the flat summary row, in report order.
SUMMARY_COLUMNS = ("dataset", "model", "family", "evaluation_strategy", "accuracy_mean", "accuracy_std",
                   "precision_mean", "precision_std", "recall_mean", "recall_std", "f1_mean", "f1_std",
                   "baseline_f1_mean", "baseline_f1_std", "p_value", "significant", "direction",
                   "learning_rate", "batch_size", "epochs", "optimizer", "loss_function",
                   "class_weight_mode", "tuning_profile", "hardware")
