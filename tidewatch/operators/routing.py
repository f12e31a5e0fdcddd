"""Three-way routing: counts, quality of a policy, sweep of its thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.portable import ratio
from ..functions.scalar import route
from .thresholds import grid_cell


@dataclass(frozen=True)
class Policy:
    """Two thresholds, three topic names, and whether the uncertain band is reviewed."""

    anomaly_above: float = 0.8
    normal_up_to: float = 0.2
    topics: tuple[str, str, str] = ("anomaly", "normal", "uncertain")
    review_uncertain: bool = True


# Fixed values of the sweep: tried thresholds, and the tolerances of the conservative choice.
SWEEP_ANOMALY = (0.8, 0.75, 0.7, 0.65, 0.6, 0.55)
SWEEP_NORMAL = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45)
RECALL_LOSS, FPR_RISE, PRECISION_LOSS = 0.10, 0.01, 0.01


def with_route(df: DataFrame, score: str = "score", policy: Policy = Policy(), name: str = "route",
               null_is_zero: bool = False) -> DataFrame:
    """Route column. The live path reads a missing score as 0.0; the batch path leaves it without a route."""
    s = F.coalesce(F.col(score), F.lit(0.0)) if null_is_zero else F.col(score)
    return df.withColumn(name, route(s, policy.anomaly_above, policy.normal_up_to, policy.topics))


def route_counts(df: DataFrame, route_col: str = "route", by: list[str] = (),
                 policy: Policy = Policy()) -> DataFrame:
    """Count and share of each route per group."""
    total = F.count(F.lit(1))
    names = dict(zip(("anomaly", "normal", "uncertain"), policy.topics))
    counts = {n: F.count_if(F.col(route_col) == t) for n, t in names.items()}
    return df.groupBy(*by).agg(total.alias("total"), *[c.alias(f"{n}_count") for n, c in counts.items()],
                               *[ratio(c, total).alias(f"{n}_ratio") for n, c in counts.items()])


def _quality(counts: DataFrame) -> DataFrame:
    """Policy measures from band counts split by label."""
    c = F.col
    positives = c("anomaly_pos") + c("normal_pos") + c("uncertain_pos")
    negatives = c("anomaly_neg") + c("normal_neg") + c("uncertain_neg")
    total = positives + negatives
    alerts, band = c("anomaly_pos") + c("anomaly_neg"), c("uncertain_pos") + c("uncertain_neg")
    zero = F.lit(0).cast("bigint")
    review, caught = F.when(c("reviewed"), band).otherwise(zero), F.when(c("reviewed"), c("uncertain_pos")).otherwise(zero)
    out = counts.withColumns({
        "anomaly_topic_count": alerts, "normal_topic_count": c("normal_pos") + c("normal_neg"),
        "uncertain_band_count": band, "review_topic_count": review,
        "uncertain_band_ratio": ratio(band, total), "review_load_ratio": ratio(review, total),
        "precision_on_auto_alert": ratio(c("anomaly_pos"), alerts),
        "recall_on_auto_alert": ratio(c("anomaly_pos"), positives),
        "fpr_on_auto_alert": ratio(c("anomaly_neg"), negatives),
        "effective_recall_with_review": ratio(c("anomaly_pos") + caught, positives),
        "normal_bucket_positive_count": c("normal_pos"), "_positives": positives})
    p, r = c("precision_on_auto_alert"), c("recall_on_auto_alert")
    return out.withColumns({
        "f1_on_auto_alert": ratio(F.lit(2.0) * p * r, p + r),
        "residual_miss_rate_after_review": F.when(
            c("_positives") > 0, F.lit(1.0) - c("effective_recall_with_review")).otherwise(0.0),
    }).drop("_positives", "reviewed", *[f"{b}_{s}" for b in ("anomaly", "normal", "uncertain") for s in ("pos", "neg")])


def policy_quality(df: DataFrame, score: str, label: str, policies: dict[str, Policy],
                   by: list[str] = ()) -> DataFrame:
    """Quality of several policies in one pass, one row per policy (and group).

    Scores are counted per threshold cell and label first; policies are judged
    on those few cells.
    """
    ordered = sorted({t for p in policies.values() for t in (p.anomaly_above, p.normal_up_to)})
    s = F.col(score).cast("double")
    cells = (df.where(s.isNotNull()).withColumn("_cell", grid_cell(s, ordered, strict=True)).groupBy(*by, "_cell")
             .agg(F.count_if(F.col(label) == 1).alias("_pos"),
                  F.count_if(~F.coalesce(F.col(label) == 1, F.lit(False))).alias("_neg")))
    listed = F.array(*[F.struct(F.lit(n).alias("policy_name"), F.lit(p.anomaly_above).alias("anomaly_threshold"),
                                F.lit(p.normal_up_to).alias("normal_threshold"),
                                F.lit(p.review_uncertain).alias("reviewed"),
                                F.lit(ordered.index(p.anomaly_above)).alias("_a"),
                                F.lit(ordered.index(p.normal_up_to)).alias("_n"))
                       for n, p in policies.items()])
    judged = cells.select("*", F.inline(listed))
    bands = {"anomaly": F.col("_cell") > F.col("_a"), "normal": (F.col("_cell") <= F.col("_n")) & (F.col("_cell") <= F.col("_a"))}
    bands["uncertain"] = ~(bands["anomaly"] | bands["normal"])
    sums = [F.coalesce(F.sum(F.when(cond, F.col(f"_{side}"))), F.lit(0)).alias(f"{b}_{side}")
            for b, cond in bands.items() for side in ("pos", "neg")]
    keys = [*by, "policy_name", "anomaly_threshold", "normal_threshold", "reviewed"]
    return _quality(judged.groupBy(*keys).agg(*sums))


def sweep_policies(anomaly=SWEEP_ANOMALY, normal=SWEEP_NORMAL) -> dict[str, Policy]:
    return {f"route_uncertain_a{a:.2f}_n{n:.2f}": Policy(a, n) for a in anomaly for n in normal if n < a}


def threshold_sweep(df: DataFrame, score: str, label: str, baseline: Policy = Policy(),
                    policies: dict[str, Policy] | None = None) -> DataFrame:
    """Every tried pair of thresholds with its distance from the baseline and the recommended pair.

    The recommendation keeps the baseline's anomaly threshold, allows small
    losses only, and takes the lowest review load; if nothing qualifies, all
    pairs compete.
    """
    tried = policies or sweep_policies()
    everything = policy_quality(df, score, label, {**tried, "_baseline": baseline})
    b = F.struct(*[c for c in everything.columns if c.endswith(("ratio", "alert", "review"))])
    rows = everything.where(F.col("policy_name") != "_baseline").withColumn(
        "_b", everything.where(F.col("policy_name") == "_baseline").select(b.alias("b")).scalar())
    rows = rows.withColumns({f"delta_{m}": F.col(m) - F.col("_b")[m] for m in (
        "review_load_ratio", "effective_recall_with_review", "fpr_on_auto_alert", "precision_on_auto_alert")})
    a_gap = F.abs(F.col("anomaly_threshold") - baseline.anomaly_above)
    n_gap = F.abs(F.col("normal_threshold") - baseline.normal_up_to)
    careful = ((a_gap < 1e-9)
               & (F.col("effective_recall_with_review") >= F.col("_b.effective_recall_with_review") - RECALL_LOSS)
               & (F.col("fpr_on_auto_alert") <= F.col("_b.fpr_on_auto_alert") + FPR_RISE)
               & (F.col("precision_on_auto_alert") >= F.col("_b.precision_on_auto_alert") - PRECISION_LOSS))
    rows = rows.withColumns({"is_baseline": (a_gap < 1e-9) & (n_gap < 1e-9), "_careful": careful.cast("int")})
    rank = F.struct((-F.col("_careful")).alias("c"), F.col("review_load_ratio"),
                    (-F.col("effective_recall_with_review")).alias("r"), F.col("fpr_on_auto_alert"),
                    (-F.col("precision_on_auto_alert")).alias("p"), a_gap.alias("ag"), n_gap.alias("ng"))
    best = rows.agg(F.min_by("policy_name", rank).alias("n"))
    return rows.withColumn("is_recommended", F.col("policy_name") == best.scalar()).drop("_b", "_careful")
