"""Writers. Partitions are kept; one file only where a caller asks for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import ranked, with_range_bucket
from ..schema import LABEL, TIMESTAMP


def write_csv(df: DataFrame, path: str, mode: str = "error", single_file: bool = False) -> None:
    """CSV with header. ``single_file`` writes through one task, whatever the size: the caller's choice."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)


def dataset_layout(df: DataFrame, features: list[str], order: str | None = None,
                   label: str = LABEL, ts: str = TIMESTAMP) -> DataFrame:
    """Time, label, then features; a missing time becomes 0..n-1 along ``order``."""
    if ts not in df.columns:
        if order is None:
            raise ValueError("a table without a time column needs an order column")
        df = ranked(with_range_bucket(df, order), [], [order], "_row").withColumn(
            ts, (F.col("_row") - 1).cast("double"))
    return df.select(F.col(ts).cast("double").alias(ts), F.col(label).cast("int").alias(label),
                     *[F.col(c).cast("double").alias(c) for c in features])


def union_ragged(frames: list[DataFrame], preferred: list[str] = ()) -> DataFrame:
    """Union by name with missing columns as null: preferred columns first, then as first seen."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    head = [c for c in preferred if c in whole.columns]
    return whole.select(*head, *[c for c in whole.columns if c not in head])


def write_report(frames: list[DataFrame], path: str, preferred: list[str] = (), fmt: str = "json") -> None:
    out = union_ragged(frames, preferred).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.json(path)


def write_scores(scored: DataFrame, path: str, label: str = "label", prediction: str = "prediction") -> None:
    """(label, prediction) as JSON lines."""
    scored.select(F.col(label).cast("int").alias("label"), F.col(prediction).alias("prediction")
                  ).write.mode("overwrite").json(path)


def write_snapshots(parts: dict[tuple[str, str], DataFrame], path: str) -> None:
    """Train and test snapshots of several scenarios as one partitioned table."""
    tagged = [df.withColumns({"scenario": F.lit(s), "split": F.lit(p)}) for (s, p), df in parts.items()]
    union_ragged(tagged).write.mode("overwrite").partitionBy("scenario", "split").parquet(path)


def routed_messages(df: DataFrame, topic: Column | str, key: Column | str, value: Column) -> DataFrame:
    """The ``topic, key, value`` layout that message sinks take."""
    c = (lambda x: F.col(x) if isinstance(x, str) else x)
    return df.select(c(topic).cast("string").alias("topic"), c(key).cast("string").alias("key"), value.alias("value"))


def write_routed(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Routed messages as JSON lines, one folder per topic; the file twin of a topic sink."""
    messages.write.mode(mode).partitionBy("topic").json(path)
