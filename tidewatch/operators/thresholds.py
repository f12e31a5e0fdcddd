"""Threshold choice on scores.

Scores are reduced to counts per grid cell in one map-side aggregate; each
threshold's confusion counts are sums over those few cells. Rows never meet
the grid one by one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .metrics import with_measures

CLASSIFIER_START = 0.5
# The classifier grid is 37 points from 0.05 to 0.95, the error grid 41 points.
CLASSIFIER_GRID = [float(t) for t in np.linspace(0.05, 0.95, 37)]
ERROR_STEPS = 41


def grid_cell(score: Column, ordered: list[float], strict: bool = False) -> Column:
    """How many of the ascending thresholds the score reaches (or exceeds, when ``strict``)."""
    hits = [(score > t if strict else score >= t).cast("int") for t in ordered]
    return reduce(lambda a, b: a + b, hits)


def threshold_measures(df: DataFrame, score: str, label: str, thresholds: list[float],
                       by: list[str] = ()) -> DataFrame:
    """Confusion counts and measures per threshold, ``score >= threshold`` being positive.

    ``step`` is the threshold's place in the given list.
    """
    ordered = sorted(set(thresholds))
    s = F.col(score).cast("double")
    cells = (df.where(s.isNotNull()).withColumn("_cell", grid_cell(s, ordered)).groupBy(*by, "_cell")
             .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")))
    listed = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold"), F.lit(ordered.index(t)).alias("_t"))
                       for i, t in enumerate(thresholds)])
    up = F.col("_cell") > F.col("_t")
    count = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    per_step = cells.select("*", F.inline(listed)).groupBy(*by, "step", "threshold").agg(
        count(up, "_pos").alias("tp"), count(~up, "_neg").alias("tn"),
        count(up, "_neg").alias("fp"), count(~up, "_pos").alias("fn"))
    return with_measures(per_step)


def best_threshold(measured: DataFrame, by: list[str] = ()) -> DataFrame:
    """The step with the best (f1, precision, recall, -error rate); the earliest wins ties."""
    signature = F.struct("f1", "precision", "recall", (-F.col("error_rate")).alias("e"), (-F.col("step")).alias("s"))
    kept = [c for c in measured.columns if c not in by and c != "step"]
    return measured.groupBy(*by).agg(F.max_by(F.struct(*kept), signature).alias("b")).select(*by, "b.*")


def pick_classifier_threshold(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    grid = [CLASSIFIER_START, *CLASSIFIER_GRID]
    return best_threshold(threshold_measures(df, score, label, grid, by), by)


def pick_error_threshold(df: DataFrame, error: str, label: str) -> DataFrame:
    """Threshold on reconstruction errors from an even grid over their range."""
    low, high = df.agg(F.min(F.col(error).cast("double")), F.max(F.col(error).cast("double"))).first()
    if low is None:
        raise ValueError("no errors to choose a threshold from")
    grid = [low] if np.isclose(low, high) else [low, *map(float, np.linspace(low, high, ERROR_STEPS))]
    return best_threshold(threshold_measures(df, error, label, grid))
