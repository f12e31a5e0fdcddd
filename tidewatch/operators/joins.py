"""Lookups and reconciliations. Spark broadcasts a side by its bytes, known at run time; hot keys are salted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.portable import ratio
from ..shared import written

# A key is hot above 1 / (HOT_SHARE x shuffle partitions) of all rows, and never below MIN_HOT rows.
HOT_SHARE, MIN_HOT = 4, 10_000


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join with a lookup table; Spark broadcasts it where its bytes are few, at run time, and shuffles otherwise."""
    return df.join(dim, keys, how)


def lookup_name(df: DataFrame, dim: DataFrame, code: str, name: str) -> DataFrame:
    """Display name of a code; a code without metadata stands for itself."""
    return lookup(df, dim, [code]).withColumn(name, F.coalesce(F.col(name), F.col(code).cast("string")))


def last_per_key(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The last row per key. A mergeable aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_l")).select(*keys, "_l.*").select(*df.columns)


def dealt(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Rows of the keys in ``hot`` (key, _salts) as (row, _share, _salt): equal rows are merged, then shared out among the salts.

    The salt follows from the row's content and the piece's number, so it does not depend on where or in which order a task
    meets its rows, and a task that runs again deals them out alike. Copies of one row are spread too.
    """
    merged = df.join(F.broadcast(hot), key).groupBy(*df.columns, "_salts").agg(F.count(F.lit(1)).alias("_n"))
    pieces = merged.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_n"), F.col("_salts")) - 1)))
    share = F.expr("_n div _salts") + (F.col("_piece") < F.col("_n") % F.col("_salts")).cast("int")
    return pieces.select(*df.columns, share.cast("int").alias("_share"),
                         F.pmod(F.pmod(F.xxhash64(*df.columns), "_salts") + F.col("_piece"), "_salts").cast("int").alias("_salt"))


def salted(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Column ``_salt``: 0 but for rows of a key in ``hot`` (key, _salts), which are dealt out by their content."""
    cold = df.join(F.broadcast(hot.select(key)), key, "left_anti").withColumn("_salt", F.lit(0))
    spread = dealt(df, hot, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_share")))
    return cold.unionByName(spread.select(*cold.columns))


def spread_join(df: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join many rows to one row per key (inner, left or left_anti), with hot keys salted.

    Keys that fill more than a fair share of a shuffle partition are counted
    first; there are at most ``HOT_SHARE`` x partitions of them, so their table
    is small by construction. Rows of a hot key are dealt out by their content
    (see ``dealt``), and the key's single side row is repeated once per salt.
    Rows without a key meet nothing and are not shuffled.
    """
    spark = df.sparkSession
    parts = HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fair = F.greatest(counts.agg(F.sum("_n").alias("n")).scalar() / parts, F.lit(MIN_HOT))
    hot = counts.withColumn("_fair", fair).where("_n > _fair").select(
        key, F.ceil(F.col("_n") / F.col("_fair")).cast("int").alias("_salts"))
    hot = written(hot, "hotkeys")
    cold = df.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(side, key, how)
    right = side.join(F.broadcast(hot), key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    joined = dealt(df, hot, key).join(right, [key, "_salt"], how)
    out = cold.unionByName(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_share"))).select(*cold.columns))
    return out if how == "inner" else out.unionByName(df.where(F.col(key).isNull()), allowMissingColumns=True)


def attach_scores(records: DataFrame, scores: DataFrame, key: str, order: str) -> DataFrame:
    """Records with the last score of their key; records without a score are dropped."""
    return spread_join(records, last_per_key(scores, [key], order).drop(order), key)


def attach_lag(records: DataFrame, lag: DataFrame, keys: list[str] = ("topic", "partition")) -> DataFrame:
    """Records with the consumer lag of their partition, 0 where unknown."""
    return lookup(records, lag, list(keys)).withColumn("consumer_lag", F.coalesce("consumer_lag", F.lit(0)))


def consumer_lag(offsets: DataFrame, by: list[str] = ("topic", "partition")) -> DataFrame:
    """Lag per partition: end offset minus offset read, never below zero."""
    lag = F.greatest(F.lit(0), F.max("end_offset") - F.max("until_offset"))
    return offsets.groupBy(*by).agg(lag.cast("bigint").alias("consumer_lag"))


def with_baseline(runs: DataFrame, baseline: DataFrame, keys: list[str], measure: str = "f1") -> DataFrame:
    """Model run and baseline run of the same key side by side."""
    side = baseline.select(*keys, F.col(measure).alias(f"baseline_{measure}"))
    return runs.join(side, keys).withColumn("lift", F.col(measure) - F.col(f"baseline_{measure}"))


def paired_deltas(base: DataFrame, treated: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Measures before, after and their difference for keys present in both."""
    a = base.select(*keys, *[F.col(m).alias(f"{m}_base") for m in measures])
    b = treated.select(*keys, *[F.col(m).alias(f"{m}_new") for m in measures])
    return a.join(b, keys).withColumns({f"{m}_delta": F.col(f"{m}_new") - F.col(f"{m}_base") for m in measures})


def deltas_to_row(df: DataFrame, is_reference: Column, measures: list[str]) -> DataFrame:
    """Every row's distance from one reference row, which enters as a scalar subquery."""
    ref = df.where(is_reference).agg(F.struct(*[F.max(m).alias(m) for m in measures]).alias("r")).scalar()
    return df.withColumn("_r", ref).withColumns(
        {f"delta_{m}": F.col(m) - F.col("_r")[m] for m in measures}).drop("_r")


def lost_messages(sent: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Sent messages that were never delivered."""
    return spread_join(sent, delivered.select(key).distinct(), key, "left_anti")


def delivery(sent: DataFrame, delivered: DataFrame, key: str, expected: str, actual: str,
             alert: str, by: list[str] = ()) -> DataFrame:
    """Loss rate and alert delivery success. ``sent`` names the expected topic, ``delivered`` the actual one."""
    got = delivered.groupBy(key).agg(F.max(actual).alias(actual), F.count(F.lit(1)).alias("_copies"))
    both = spread_join(sent, got, key, "left")
    due = F.col(expected) == alert
    arrived = due & F.coalesce(F.col(actual) == F.col(expected), F.lit(False))
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("input_messages"),
                                F.count_if(F.col("_copies").isNull()).alias("lost_messages"),
                                F.count_if(due).alias("expected_alerts"), F.count_if(arrived).alias("delivered_alerts"))
    return out.select("*", ratio("lost_messages", "input_messages").alias("message_loss_rate"),
                      ratio("delivered_alerts", "expected_alerts").alias("alert_delivery_success"))


def top_rows(df: DataFrame, by: list[str], measures: list[str], n: int, tie: str) -> DataFrame:
    """The n best rows per group by descending measures; map-side limited before the shuffle."""
    order = [F.desc(m) for m in measures] + [F.col(tie)]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
