"""Leaderboards, operational KPIs and flat summaries over metrics tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.portable import ratio
from ..schema import SUMMARY_COLUMNS
from .joins import last_per_key, top_rows

RANKING = ["f1_mean", "recall_mean", "precision_mean"]


def merged_results(frames: list[tuple[str, DataFrame]], preferred: list[str] = ()) -> DataFrame:
    """Result tables in order, tagged by source; the last row per (dataset, model) stays."""
    from ..sources.writers import union_ragged

    tagged = [df.withColumns({"result_source": F.lit(name), "_seq": F.lit(i)}) for i, (name, df) in enumerate(frames)]
    merged = last_per_key(union_ragged(tagged, preferred), ["dataset", "model"], "_seq").drop("_seq")
    return merged.orderBy("dataset", *(["family"] if "family" in merged.columns else []), "model")


def best_per_dataset(summary: DataFrame, dataset: str = "dataset", model: str = "model",
                     measures: list[str] = RANKING) -> DataFrame:
    """Best row per dataset by descending measures; a mergeable aggregate."""
    return _best(summary, [dataset], measures, model)


def best_per_family(summary: DataFrame, dataset: str = "dataset", family: str = "family", model: str = "model",
                    measure: str = "f1_mean") -> DataFrame:
    return _best(summary, [dataset, family], [measure], model)


def _best(df: DataFrame, by: list[str], measures: list[str], tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    key = F.struct(*[(-F.col(m)).alias(f"m{i}") for i, m in enumerate(measures)], F.col(tie))
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_b")).select(*by, "_b.*")


def leader_gaps(summary: DataFrame, dataset: str = "dataset", model: str = "model", measure: str = "f1_mean",
                measures: list[str] = RANKING) -> DataFrame:
    """First, second and their gap per dataset; only the top two rows of a group are ever gathered."""
    two = top_rows(summary, [dataset], measures, 2, model)
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    return two.groupBy(dataset).agg(at(1, model).alias("best_model"), at(1, measure).alias("best_score"),
                                    at(2, model).alias("second_model"), at(2, measure).alias("second_score"),
                                    (at(1, measure) - at(2, measure)).alias("gap"))


def family_gaps(summary: DataFrame, dataset: str = "dataset", family: str = "family", model: str = "model",
                measure: str = "f1_mean") -> DataFrame:
    """Best of each family against the best of the dataset."""
    fam = best_per_family(summary, dataset, family, model, measure).select(dataset, family, model, measure)
    top = fam.groupBy(dataset).agg(F.max(measure).alias("best_score"))
    return fam.join(top, dataset).withColumn("gap", F.col("best_score") - F.col(measure))


def operational_kpis(df: DataFrame, precision: str = "precision_mean", recall: str = "recall_mean",
                     f1: str = "f1_mean", baseline_f1: str = "baseline_f1_mean", total: str = "total_rows",
                     normal: str = "normal_rows", anomaly: str = "anomaly_rows") -> DataFrame:
    """What a model of given quality means for the people who check its alarms."""
    c = lambda n: F.col(n).cast("double")
    hits = df.withColumn("tp", c(recall) * c(anomaly))
    flagged = hits.withColumn("predicted_positive", F.when(c(precision) > 0, F.col("tp") / c(precision)).otherwise(0.0))
    tp, pp = F.col("tp"), F.col("predicted_positive")
    per_1000 = lambda x: ratio(x, c(total)) * 1000.0
    staged = flagged.withColumns({"fn": c(anomaly) - tp, "fp": F.greatest(pp - tp, F.lit(0.0))})
    return staged.withColumns({
        "prevented_manual_checks": F.greatest(c(total) - pp, F.lit(0.0)),
        "review_reduction": F.when(c(total) > 0, F.lit(1.0) - pp / c(total)).otherwise(0.0),
        "review_compression": ratio(c(total), pp), "false_positive_rate": ratio(F.col("fp"), c(normal)),
        "miss_rate": ratio(F.col("fn"), c(anomaly)),
        "baseline_lift": F.when(c(baseline_f1) > 0, c(f1) / c(baseline_f1)).otherwise(0.0),
        "alerts_per_1000": per_1000(pp), "caught_per_1000": per_1000(tp), "false_alarms_per_1000": per_1000(F.col("fp"))})


def tuning_scores(runs: DataFrame, candidate: list[str]) -> DataFrame:
    """Mean validation and test F1 per candidate over datasets."""
    return runs.groupBy(*candidate).agg(F.avg("validation_f1").alias("mean_validation_f1"),
                                        F.avg("test_f1").alias("mean_test_f1"))


def pick_candidate(scores: DataFrame, model: str, order: str) -> DataFrame:
    """Best candidate per model by (validation, test) F1; the first tried wins ties."""
    return _best(scores, [model], ["mean_validation_f1", "mean_test_f1"], order)


def mean_by_regime(summary: DataFrame, regime: str, measure: str = "f1_mean") -> DataFrame:
    return summary.groupBy(regime).agg(F.avg(measure).alias(f"mean_{measure}"), F.count(F.lit(1)).alias("models"))


def flat_summary(payload: DataFrame) -> DataFrame:
    """Nested experiment report to the flat 25-column summary row."""
    meta = "model.metadata."
    source = {"dataset": "dataset.name", "model": "model.name", "family": "model.family",
              "evaluation_strategy": "protocol.strategy", "baseline_f1_mean": "baseline_summary.f1_mean",
              "baseline_f1_std": "baseline_summary.f1_std", "p_value": "statistical_test.p_value",
              "significant": "statistical_test.significant", "direction": "statistical_test.direction"}
    tail = SUMMARY_COLUMNS[17:]
    cols: list[Column] = []
    for c in SUMMARY_COLUMNS:
        path = source.get(c) or (meta + c if c in tail else f"summary.{c}")
        col = F.col(path)
        cols.append((F.coalesce(col, F.lit("N/A")) if c in ("class_weight_mode", "tuning_profile") else col).alias(c))
    return payload.select(*cols)
