"""Labelling and cleaning of sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.portable import reading
from ..functions.scalar import WAVELET_FLAG_LEVEL, wavelet, z_score


def wavelet_label(df: DataFrame, columns: list[str], label: str = "label", amplitude: float = 1.0,
                  level: float = WAVELET_FLAG_LEVEL) -> DataFrame:
    """Label 1 where any reading's wavelet response exceeds ``level``; otherwise the label is kept.

    A null or NaN reading leaves the label unchanged. One projection for all columns.
    """
    strongest = [F.abs(wavelet(reading(c), amplitude)) for c in columns]
    peak = F.greatest(*strongest) if len(strongest) > 1 else strongest[0]
    kept = F.col(label) if label in df.columns else F.lit(0)
    return df.withColumn(label, F.when(peak > level, F.lit(1)).otherwise(kept).cast("int"))


def remove_outliers(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Drop rows with |z| > limit, column after column.

    Each column's mean and deviation come from the rows that survived the
    columns before it. Per column one narrow scan brings two numbers to the
    driver, and they enter the next scan as literals: no lineage grows and
    nothing is materialised. Null and NaN readings and a zero spread drop nothing.
    """
    kept = df
    for c in columns:
        mean, std = kept.agg(F.avg(reading(c)), F.stddev_samp(reading(c))).first()
        if mean is None or not std:
            continue
        kept = kept.where(~F.coalesce(F.abs(z_score(c, mean, std)) > limit, F.lit(False)))
    return kept


def remove_outliers_at_once(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Drop rows with |z| > limit in any column, all statistics taken from the full table."""
    stats = df.agg(F.struct(*[F.struct(F.avg(reading(c)).alias("m"), F.stddev_samp(reading(c)).alias("s")).alias(c)
                              for c in columns]).alias("z")).scalar()
    far = F.lit(False)
    for c in columns:
        z = z_score(c, F.col("_z")[c]["m"], F.col("_z")[c]["s"])
        far = far | F.coalesce(F.abs(z) > limit, F.lit(False))
    return df.withColumn("_z", stats).where(~far).drop("_z")
