"""Dataset profiling: counts, nulls, moments, histograms, correlations, trends."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.portable import ratio, reading
from ..schema import LABEL_CANDIDATES
from .ordered import null_safe_join, quantiles, with_previous, with_range_bucket


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def aligned(df: DataFrame, other: DataFrame) -> DataFrame:
    """The columns of ``df`` in the order of ``other``."""
    return df.select(*other.columns)


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Same column names in the same order."""
    return a.columns == b.columns


def scatter_projection(df: DataFrame, label: str) -> DataFrame:
    """First two numeric columns and the label."""
    first, second = [c for c in numeric_columns(df) if c != label][:2]
    return df.select(first, second, label)


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Wide readings to (column_name, reading) rows."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), columns, "column_name", "reading")


def channel_of(name: str | Column) -> tuple[Column, Column]:
    """Subsystem and signal type encoded in a sensor column name."""
    c = F.col(name) if isinstance(name, str) else name
    kind = F.when(c.startswith("I_"), "current").when(c.endswith("_power"), "power").otherwise("voltage")
    return F.get(F.split(c, "_"), F.lit(2)), kind


def channels(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Sensor table as (subsystem, signal_type, column_name, reading) rows."""
    subsystem, kind = channel_of("column_name")
    return long_form(df, columns, keep).withColumns({"subsystem": subsystem, "signal_type": kind})


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of present readings per subsystem and signal type."""
    return channels(df, columns).groupBy("subsystem", "signal_type").agg(
        F.count("reading").alias("available"), F.count(F.lit(1)).alias("expected"),
        ratio(F.count("reading"), F.count(F.lit(1))).alias("coverage"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def class_roles(df: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """One row (per group): majority and minority class, their counts, and how many rows to generate.

    Equal counts are settled by the smallest label.
    """
    per = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("rows"))
    return per.groupBy(*by).agg(
        F.min_by(label, F.struct(-F.col("rows"), F.col(label))).alias("majority"),
        F.max("rows").alias("majority_rows"),
        F.min_by(label, F.struct("rows", F.col(label))).alias("minority"),
        F.min("rows").alias("minority_rows"),
        (F.max("rows") - F.min("rows")).alias("to_generate"),
        F.count(F.lit(1)).alias("classes"))


def null_counts(df: DataFrame, columns: list[str] | None = None, only_missing: bool = False) -> DataFrame:
    """Missing readings per column in one pass; NaN is missing too."""
    names = columns or df.columns
    float_like = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    wide = df.agg(*[F.count_if((reading(c) if c in float_like else F.col(c)).isNull()).alias(c) for c in names])
    out = wide.unpivot([], names, "column_name", "missing")
    return out.where("missing > 0") if only_missing else out


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation and minimum per column in one pass."""
    stats = [F.struct(F.lit(c).alias("column_name"), F.avg(reading(c)).alias("mean"), F.stddev_samp(reading(c)).alias("std"),
                      F.min(reading(c)).alias("minimum")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def label_column(df: DataFrame) -> str | None:
    return next((c for c in LABEL_CANDIDATES if c in df.columns), None)


def imbalance(df: DataFrame, label: str | None = None) -> DataFrame:
    """Rows, normals, anomalies, anomaly share and normal:anomaly ratio. "0" and "0.0" are both normal."""
    name = label or label_column(df)
    text = F.trim(F.col(name).cast("string")) if name else F.lit(None).cast("string")
    base = df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(text.isin("0", "0.0")).alias("normal_rows"),
                  F.count_if(text.isin("1", "1.0")).alias("anomaly_rows"))
    return base.select("*", (ratio("anomaly_rows", "total_rows") * 100).alias("anomaly_pct"),
                       ratio("normal_rows", "anomaly_rows").alias("normal_to_anomaly"),
                       F.lit(name or "N/A").alias("label_column"))


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of a table and a derived one, with growth and reduction against the first."""
    n = F.count(F.lit(1)).alias("n")
    b, a = before.agg(n).scalar(), after.agg(n).scalar()
    one = before.sparkSession.range(1).select(b.alias("rows_before"), a.alias("rows_after"))
    return one.select("*", (ratio("rows_after", "rows_before") - 1).alias("growth"),
                      (F.lit(1.0) - ratio("rows_after", "rows_before")).alias("reduction"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson matrix in long form; every pair in one aggregate."""
    pairs = list(combinations_with_replacement(columns, 2))
    cells = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                      F.corr(reading(a), reading(b)).alias("r")) for a, b in pairs]
    half = df.agg(F.array(*cells).alias("s")).select(F.inline("s"))
    mirrored = F.when(F.col("column_a") == F.col("column_b"), F.array(F.struct("column_a", "column_b", "r"))).otherwise(
        F.array(F.struct("column_a", "column_b", "r"),
                F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r")))
    return half.select(F.inline(mirrored))


def histogram(df: DataFrame, columns: list[str], bins: int = 50, by: list[str] = ()) -> DataFrame:
    """Equal-width bins per column (and group); the top edge falls into the last bin, NaN and null into none."""
    edges = df.agg(F.struct(*[F.struct(F.min(reading(c)).alias("lo"),
                                       F.max(reading(c)).alias("hi")).alias(c) for c in columns])
                   .alias("e")).scalar()
    bounded = df.select(*by, *[reading(c).alias(c) for c in columns]).withColumn("_e", edges)
    share = {c: F.try_divide(F.col(c) - F.col("_e")[c]["lo"],
                             F.col("_e")[c]["hi"] - F.col("_e")[c]["lo"]) for c in columns}
    binned = bounded.select(*by, *[F.when(F.col(c).isNotNull(), F.least(
        F.coalesce(F.floor(s * bins), F.lit(0)), F.lit(bins - 1)).cast("int")).alias(c) for c, s in share.items()])
    return (binned.unpivot(list(by), columns, "column_name", "bin").where(F.col("bin").isNotNull())
            .groupBy(*by, "column_name", "bin").agg(F.count(F.lit(1)).alias("n")))


def value_counts(df: DataFrame, column: str, by_count: bool = False) -> DataFrame:
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), column) if by_count else out.orderBy(column)


def distribution_by_label(df: DataFrame, label: str, column: str) -> DataFrame:
    """Count, minimum, quartiles and maximum per class; NaN readings are missing. Classes without a reading have n = 0."""
    box = quantiles(df, [label], column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v = reading(column)
    ends = df.groupBy(label).agg(F.count(v).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"))
    return null_safe_join(ends, box, [label], "left")


def trend(df: DataFrame, ts: str, column: str, unit: str = "day") -> DataFrame:
    """Mean of a reading per time unit over all rows that have one; ``n`` counts rows."""
    return df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("period")).agg(
        F.avg(reading(column)).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def time_profile(df: DataFrame, order: str, ts: str, label: str) -> DataFrame:
    """Time span, first anomaly by row order and by time, and whether time never steps back."""
    stepped = with_previous(with_range_bucket(df.select(order, ts, label), order), [], order, {"_before": ts})
    steps = stepped.agg(F.count_if(F.col(ts) < F.col("_before")).alias("n_back"))
    hit = F.col(label) == 1
    return df.agg((F.max(ts) - F.min(ts)).alias("time_span"),
                  F.coalesce(F.min(F.when(hit, F.col(order))), F.lit(-1)).alias("first_anomaly_row"),
                  F.coalesce(F.min_by(F.col(ts).cast("double"), F.when(hit, F.col(order))), F.lit(-1.0)
                             ).alias("first_anomaly_row_ts"),
                  F.coalesce(F.min(F.when(hit, F.col(ts).cast("double"))), F.lit(-1.0)).alias("first_anomaly_ts")
                  ).withColumn("steps_back", steps.scalar()).withColumn("monotonic", F.col("steps_back") == 0)


def process_indicators(df: DataFrame, order: str, ts: str, label: str, power: Column, by: list[str] = ()) -> DataFrame:
    """Aggregate power per row, its mean and median, class contrast, window length and energy, per group.

    Energy is the trapezoid integral of power over time (seconds). A row whose
    power is null or NaN counts for no power figure, and has no trapezoid on
    either side. All groups share the same passes.
    """
    p = power.cast("double")
    base = df.select(*by, order, F.col(ts).alias("_t"), F.col(label).alias("_l"), F.nanvl(p, F.lit(None).cast("double")).alias("_p"))
    pairs = with_previous(with_range_bucket(base, order), by, order, {"_t0": "_t", "_p0": "_p"})
    energy = pairs.groupBy(*by).agg(F.sum((F.col("_p") + F.col("_p0")) / 2 * (F.col("_t") - F.col("_t0"))).alias("energy"))
    normal, odd = F.avg(F.when(F.col("_l") == 0, F.col("_p"))), F.avg(F.when(F.col("_l") == 1, F.col("_p")))
    means = base.groupBy(*by).agg(F.avg("_p").alias("mean_power"), normal.alias("normal_mean_power"),
                                  (odd - normal).alias("anomaly_minus_normal"),
                                  (F.max("_t") - F.min("_t")).alias("window_seconds"),
                                  F.avg(F.col("_l").cast("double")).alias("anomaly_rate"))
    medians = quantiles(base, by, "_p", {"median_power": 0.5})
    if not by:
        return means.withColumns({"median_power": medians.scalar(), "energy": energy.scalar()})
    return null_safe_join(null_safe_join(means, medians, by, "left"), energy, by, "left")


def relative_change(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Indicator, value in each of two one-row tables, and change relative to the first."""
    b = before.select(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("s")).scalar()
    a = after.select(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]).alias("s")).scalar()
    both = before.sparkSession.range(1).select(b.alias("b"), a.alias("a"))
    rows = F.array(*[F.struct(F.lit(c).alias("indicator"), F.col("b")[c].alias("before"), F.col("a")[c].alias("after"))
                     for c in columns])
    return both.select(F.inline(rows)).withColumn("relative_change", F.try_divide(
        F.col("after") - F.col("before"), F.col("before")))
