"""Column scaling with statistics as one-row scalar subqueries; fit and apply tables may differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import quantiles
from ..functions.portable import reading
from .profile import long_form


def _apply(df: DataFrame, fit: DataFrame, columns: list[str], stats, formula) -> DataFrame:
    packed = fit.agg(F.struct(*[F.struct(*stats(c)).alias(c) for c in columns]).alias("s")).scalar()
    held = df.withColumn("_s", packed)
    return held.withColumns({c: formula(reading(c), F.col("_s")[c]) for c in columns}).drop("_s")


def standard(df: DataFrame, columns: list[str], fit: DataFrame | None = None, population: bool = False) -> DataFrame:
    """(x - mean) / deviation; a constant column becomes 0."""
    dev = F.stddev_pop if population else F.stddev_samp

    def formula(x: Column, s: Column) -> Column:
        return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - s["m"], s["d"]), F.lit(0.0)))

    return _apply(df, fit or df, columns, lambda c: [F.avg(reading(c)).alias("m"), dev(reading(c)).alias("d")], formula)


def min_max(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    def formula(x: Column, s: Column) -> Column:
        return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - s["lo"], s["hi"] - s["lo"]), F.lit(0.0)))

    return _apply(df, fit or df, columns, lambda c: [F.min(reading(c)).alias("lo"),
                                                     F.max(reading(c)).alias("hi")], formula)


def min_shift(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """x - min, so that no reading is below zero."""
    return _apply(df, fit or df, columns, lambda c: [F.min(reading(c)).alias("lo")],
                  lambda x, s: x - s["lo"])


def robust(df: DataFrame, columns: list[str], fit: DataFrame | None = None,
           low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(x - median) / (q_high - q_low) with interpolated quantiles; a zero range counts as 1."""
    cuts = quantiles(long_form((fit or df).withColumns({c: reading(c) for c in columns}), columns), ["column_name"], "reading", {"mid": 0.5, "lo": low, "hi": high})
    packed = cuts.agg(F.struct(*[F.max(F.when(F.col("column_name") == c, F.struct("mid", "lo", "hi"))).alias(c)
                                 for c in columns]).alias("q")).scalar()
    held = df.withColumn("_q", packed)
    out = {}
    for c in columns:
        q = F.col("_q")[c]
        span = q["hi"] - q["lo"]
        out[c] = (reading(c) - q["mid"]) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return held.withColumns(out).drop("_q")
