"""Readers with declared schemas; no inference scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.portable import lenient_int
from ..operators.ordered import ranked, with_range_bucket
from ..schema import LABEL, TIMESTAMP


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def feature_columns(df: DataFrame, label: str = LABEL, ts: str = TIMESTAMP) -> list[str]:
    """All columns but time and label, in table order."""
    return [c for c in df.columns if c not in (label, ts)]


def load_labelled(spark: SparkSession, path: str, order: str, label: str = LABEL, ts: str = TIMESTAMP,
                  features: list[str] | None = None) -> DataFrame:
    """Labelled CSV: label to INT, features to DOUBLE, an empty time replaced by the row ordinal.

    ``order`` names the column that carries the row order of the file set; a
    distributed read has no other one.
    """
    raw = spark.read.option("header", True).csv(path)
    if label not in raw.columns:
        raise ValueError(f"the table needs a '{label}' column, it has {raw.columns}")
    names = features or [c for c in feature_columns(raw, label, ts) if c != order]
    typed = raw.select(F.col(order).cast("bigint").alias(order),
                       *([F.col(ts).cast("double").alias(ts)] if ts in raw.columns
                         else [F.lit(None).cast("double").alias(ts)]),
                       F.col(label).cast("double").cast("int").alias(label),
                       *[F.col(c).cast("double").alias(c) for c in names])
    return fill_time(typed, order, ts)


def fill_time(df: DataFrame, order: str, ts: str = TIMESTAMP) -> DataFrame:
    """Replace empty times by the 0-based row ordinal."""
    numbered = ranked(with_range_bucket(df, order), [], [order], "_row")
    return numbered.withColumn(ts, F.coalesce(ts, (F.col("_row") - 1).cast("double"))).drop("_row", "_bucket")


def with_label(df: DataFrame, required: int, label: str | Column = LABEL) -> DataFrame:
    """Rows whose label reads as ``required``; unreadable labels count as -1."""
    return df.where(lenient_int(label) == F.lit(required))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with blank and malformed lines skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_reports(spark: SparkSession, root: str, schema: T.StructType | str,
                 skip_file: str | None = None, multi_line: bool = True) -> DataFrame:
    """All JSON reports under a folder tree that name both a dataset and a model."""
    found = (spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", multi_line)
             .option("pathGlobFilter", "*.json").json(root)
             .withColumn("source_file", F.col("_metadata.file_name")))
    if skip_file:
        found = found.where(F.col("source_file") != skip_file)
    return found.where(F.col("dataset").isNotNull() & F.col("model").isNotNull())


def read_summary_csv(spark: SparkSession, path: str, doubles: list[str]) -> DataFrame:
    """Summary CSV read as text, then the named columns to DOUBLE ("N/A" becomes null)."""
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumns({c: F.col(c).try_cast("double") for c in doubles if c in raw.columns})


def decode_json(df: DataFrame, payload: str, schema: T.StructType | str, into: str = "body") -> DataFrame:
    """Message text to a struct with a fixed schema."""
    return df.withColumn(into, F.from_json(payload, schema))
