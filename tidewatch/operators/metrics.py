"""Confusion counts and the measures that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.portable import ratio

MEASURES = ("accuracy", "precision", "recall", "f1", "error_rate")
CELLS = ("tp", "tn", "fp", "fn")


def confusion(df: DataFrame, label: str | Column, prediction: str | Column, by: list[str] = ()) -> DataFrame:
    """tp, tn, fp, fn per group in one pass."""
    y = (F.col(label) if isinstance(label, str) else label).cast("int")
    p = (F.col(prediction) if isinstance(prediction, str) else prediction).cast("int")
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return df.groupBy(*by).agg(*[F.count_if((y == a) & (p == b)).alias(n) for n, (a, b) in cells.items()])


def with_measures(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and error rate; empty denominators give 0.0."""
    tp, tn, fp, fn = (F.col(c) for c in CELLS)
    total = tp + tn + fp + fn
    return (counts.withColumns({"accuracy": ratio(tp + tn, total), "precision": ratio(tp, tp + fp),
                                "recall": ratio(tp, tp + fn), "error_rate": ratio(fp + fn, total)})
            .withColumn("f1", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall"))))


def evaluate(df: DataFrame, label, prediction, by: list[str] = ()) -> DataFrame:
    return with_measures(confusion(df, label, prediction, by))


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of every measure over the runs, and total counts."""
    parts = []
    for m in MEASURES:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *parts,
                                 *[F.sum(c).alias(f"{c}_total") for c in CELLS])


def class_weights(df: DataFrame, label: str, from_ratio: float = 1.2) -> DataFrame:
    """Weight total / (classes x count) per class; empty unless majority / minority reaches ``from_ratio``."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    facts = per.agg(F.struct(F.sum("rows").alias("total"), F.count(F.lit(1)).alias("k"),
                             ratio(F.max("rows"), F.min("rows")).alias("skew")).alias("s")).scalar()
    held = per.withColumn("_s", facts)
    return (held.where((F.col("_s.k") >= 2) & (F.col("_s.skew") >= from_ratio))
            .withColumn("weight", F.col("_s.total") / (F.col("_s.k").cast("double") * F.col("rows"))).drop("_s"))


def single_class(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Groups that hold fewer than two classes and cannot be evaluated."""
    ends = df.groupBy(*by).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count(F.lit(1)).alias("rows"))
    return ends.where(F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi"))).select(*by, "rows")
