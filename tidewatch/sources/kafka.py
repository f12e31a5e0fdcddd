"""Option builders for the message bus. The connector jar is the cluster's to provide."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def read_options(servers: str, topic: str, starting: str = "latest", max_per_trigger: int | None = None,
                 fail_on_data_loss: bool = True) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting,
               "failOnDataLoss": str(fail_on_data_loss).lower()}
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def write_options(servers: str, acks: str = "all") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "kafka.acks": acks}


def subscribe(spark: SparkSession, servers: str, topic: str, **kwargs) -> DataFrame:
    """Message stream as ``key, value, topic, partition, offset`` with text key and value."""
    raw = spark.readStream.format("kafka").options(**read_options(servers, topic, **kwargs)).load()
    return raw.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value",
                          "topic", "partition", "offset")


def publish(messages: DataFrame, servers: str, enabled: bool = True) -> bool:
    """Send a ``topic, key, value`` frame in one job; what the bus or its connector refuses is logged, not raised."""
    if not enabled:
        return False
    if missing := {"topic", "key", "value"} - set(messages.columns):
        raise ValueError(f"messages lack {sorted(missing)}")
    try:
        messages.write.format("kafka").options(**write_options(servers)).save()
    except PySparkException:
        log.exception("publishing to %s failed", servers)
        return False
    return True
