"""Global order without a global task.

Ranks, running totals, previous rows and exact quantiles all need an order
over the whole table or over a group that may hold most of it. A plain window
would put such a group into one task. Here every ordered operator works on two
levels: rows are cut into range buckets that follow the order, each bucket is
windowed on its own, and one summary row per bucket carries what came before.
The answer does not depend on the number of buckets or partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.portable import epoch_micros, reading
from ..shared import default_buckets, written

#: A sketch's ranks are right within 1 / ACCURACY of a group.
ACCURACY = 1000

_B = "_bucket"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _as_number(df: DataFrame, column: str) -> Column:
    """A DOUBLE that grows with a numeric, date, timestamp or text column; of a text its first six bytes."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return epoch_micros(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.substring(F.hex(F.encode(column, "UTF-8")), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(column).cast("double")


def range_cuts(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles of several columns in one pass, as cut points for range buckets."""
    n = buckets or default_buckets(df.sparkSession)
    if n == 1:
        return {c: [] for c in columns}
    names = [f"_n{i}" for i in range(len(columns))]
    numbers = df.select(*[_as_number(df, c).alias(a) for a, c in zip(names, columns)])
    found = numbers.approxQuantile(names, [i / n for i in range(1, n)], 0.5 / n)
    return {c: sorted({x for x in cuts if x == x and abs(x) != float("inf")}) for c, cuts in zip(columns, found)}


def with_range_bucket(df: DataFrame, column: str, name: str = _B, buckets: int | None = None,
                      cuts: Sequence[float] | None = None) -> DataFrame:
    """Add a bucket number that grows with ``column``, cut at approximate quantiles.

    The cut points are a bounded list; ``Bucketizer`` finds the bucket by
    binary search in the JVM. Null values go to the first bucket. Any rising
    ``cuts`` give the same results downstream.
    """
    inner = list(cuts if cuts is not None else range_cuts(df, [column], buckets)[column])
    if not inner:
        return df.withColumn(name, F.lit(0))
    key = f"{name}_key"
    keyed = df.withColumn(key, F.coalesce(_as_number(df, column), F.lit(float("-inf"))))
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol=key, outputCol=name, handleInvalid="keep")
    return cut.transform(keyed).withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(0))).drop(key)


def _stand_in(df: DataFrame, key: str) -> Column:
    """The key with a fixed value of its own type in place of null."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.col(key), F.lit(0).cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.col(key), F.lit(False))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.col(key), F.lit("1970-01-01").cast(kind))
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def null_free_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add key columns that are never null and stand for ``keys`` exactly.

    Windows, aggregates and plain equi-joins on them share one partitioning;
    a null-safe join condition would shuffle the large side again.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    gaps = F.lit(0)
    for i, k in enumerate(keys):
        gaps = gaps + F.when(F.col(k).isNull(), 2**i).otherwise(0)
    return df.withColumns({**{n: _stand_in(df, k) for n, k in zip(names, keys)}, "_kz": gaps}), [*names, "_kz"]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys meet null keys; the left side's keys are kept."""
    a, names = null_free_keys(left, keys)
    b, _ = null_free_keys(right, keys)
    return a.join(b.drop(*keys), names, how).drop(*names)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
            measures: dict[str, tuple[str, Column]], bucket: str = _B, whole: bool = False) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` per group, current row included.

    ``bucket`` names a column that grows with ``order``. With ``whole`` every
    measure also gets a ``<name>_whole`` column holding its total per group.
    """
    staged, by_free = null_free_keys(df.withColumns({f"_m_{n}": c for n, (_, c) in measures.items()}), by)
    keys = [*by_free, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = staged.withColumns({n: _AGG[k](f"_m_{n}").over(inside) for n, (k, _) in measures.items()})

    # One row per (group, bucket): far smaller than the input, at most `buckets` rows for a hot group.
    totals = staged.groupBy(*keys).agg(*[_AGG[k](f"_m_{n}").alias(f"_t_{n}") for n, (k, _) in measures.items()])
    over = Window.partitionBy(*by_free)
    before = over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_a_{n}": _AGG[k](f"_t_{n}").over(before) for n, (k, _) in measures.items()}
    if whole:
        carried |= {f"{n}_whole": _AGG[k](f"_t_{n}").over(over) for n, (k, _) in measures.items()}
    ahead = totals.withColumns(carried).drop(*[f"_t_{n}" for n in measures])

    joined = local.join(ahead, keys).drop(*by_free)
    merged = {}
    for n, (k, _) in measures.items():
        a, b = F.col(f"_a_{n}"), F.col(n)
        merged[n] = (F.coalesce(a + b, b, a) if k == "sum"
                     else F.greatest(a, b) if k == "max" else F.least(a, b))
    return joined.withColumns(merged).drop(*[f"_a_{n}" for n in measures], *[f"_m_{n}" for n in measures])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rank",
           bucket: str = _B, whole: str | None = None) -> DataFrame:
    """Row number 1..n per group; ``whole`` optionally names a column for the group size."""
    one = {name: ("sum", F.lit(1).cast("bigint"))}
    out = running(df, by, order, one, bucket, whole=whole is not None)
    return out.withColumnRenamed(f"{name}_whole", whole) if whole else out


def with_previous(df: DataFrame, by: Sequence[str], order: str, columns: dict[str, str],
                  bucket: str = _B) -> DataFrame:
    """Add columns of the row just before, per group; ``order`` must be unique in a group."""
    staged, by_free = null_free_keys(df, by)
    keys = [*by_free, bucket]
    prev, last = F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), "_last"
    inside = Window.partitionBy(*keys).orderBy(order)
    local = staged.withColumn("_prev", F.lag(prev).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    tails = staged.groupBy(*keys).agg(F.max_by(prev, F.col(order)).alias(last))
    tails = tails.withColumn("_carry", F.lag(last).over(Window.partitionBy(*by_free).orderBy(bucket))).drop(last)
    out = local.join(tails, keys).drop(*by_free)
    chosen = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return (out.withColumn("_chosen", chosen)
            .withColumns({n: F.col("_chosen")[n] for n in columns})
            .drop("_prev", "_first", "_carry", "_chosen"))


def _picks(placed: DataFrame, by: Sequence[str], probs: dict[str, float], nearest_rank: bool) -> DataFrame:
    """Quantiles from rows (_v, _c) with running counts ``_upto`` and whole counts; a position always lies in a row with a value."""
    n, end, start = F.col("_upto_whole"), F.col("_upto"), F.col("_upto") - F.col("_c")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < end), F.col("_v")))

    picks, finals = [], []
    for name, q in probs.items():
        if nearest_rank:
            picks.append(at(F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0))).alias(name))
            finals.append(_found(F.col(name)))
            continue
        spot = F.lit(q) * (n - 1)
        lo, hi = F.floor(spot), F.ceil(spot)
        picks += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(spot - lo).alias(f"_w_{name}")]
        lo_v, hi_v, w = _found(F.col(f"_lo_{name}")), _found(F.col(f"_hi_{name}")), F.col(f"_w_{name}")
        finals.append(lo_v * (F.lit(1.0) - w) + hi_v * w)
    rows = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *picks)
    return rows.select(*by, *[F.when(F.col("_rows") > 0, f).alias(name) for f, name in zip(finals, probs)])


def _found(pick: Column) -> Column:
    """The value at a position; a sketch that broke its error bound must not pass for a result."""
    return F.coalesce(pick, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))


def counted_quantiles(counts: DataFrame, by: Sequence[str], value: str, n: str, probs: dict[str, float], nearest_rank: bool = False,
                      buckets: int | None = None, cuts: Sequence[float] | None = None) -> DataFrame:
    """Exact quantiles per group of a table of (value, number of readings), one row per group and value."""
    rows = counts.select(*by, reading(value).alias("_v"), F.col(n).alias("_c")).where(F.col("_v").isNotNull())
    placed = running(with_range_bucket(rows, "_v", buckets=buckets, cuts=cuts), by, ["_v"], {"_upto": ("sum", F.col("_c"))}, whole=True)
    return _picks(placed, by, probs, nearest_rank)


def bracket_counts(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Readings counted by value inside the brackets of the wanted quantiles, and by gap between them (value null).

    A mergeable sketch per group tells each quantile's rank within 1 / ACCURACY of the group, so a bracket of three times that width
    on both sides holds the exact answer and its neighbours. Groups of up to 4 * ACCURACY readings are counted whole. Rows of a
    group are ordered by (_slot, _v), nulls first; ``_at`` grows with that order.
    """
    present = df.select(*by, reading(value).alias("_v")).where(F.col("_v").isNotNull())
    ends = [min(1.0, max(0.0, q + side * 3 / ACCURACY)) for q in sorted(set(probs.values())) for side in (-1, 1)]
    sketch = present.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 4 * ACCURACY, F.percentile_approx("_v", ends, ACCURACY)).alias("_q"))
    held = (null_safe_join(present, sketch, by) if by else present.withColumn("_q", sketch.scalar()))
    v, q = F.col("_v"), F.col("_q")
    low = [F.lit(float("-inf")) if e == 0 else F.coalesce(F.get(q, F.lit(i)), F.lit(float("-inf"))) for i, e in enumerate(ends)][::2]
    high = [F.lit(float("inf")) if e == 1 else F.coalesce(F.get(q, F.lit(i)), F.lit(float("inf"))) for i, e in enumerate(ends)][1::2]
    slot, inside, next_low = F.lit(0), F.lit(False), F.lit(float("inf"))
    for lo, hi in zip(low, high):
        slot, inside = slot + (v > hi).cast("int"), inside | ((v >= lo) & (v <= hi))
    for lo in reversed(low):
        next_low = F.when(v < lo, lo).otherwise(next_low)
    keyed = held.select(*by, slot.alias("_slot"), F.when(inside, v).alias("_v"), F.when(inside, v).otherwise(next_low).alias("_at"))
    return keyed.groupBy(*by, "_slot", "_v").agg(F.min("_at").alias("_at"), F.count(F.lit(1)).alias("_c"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
              nearest_rank: bool = False, buckets: int | None = None) -> DataFrame:
    """Exact quantiles per group, interpolated or by nearest rank; null and NaN readings don't count.

    Two passes over the readings: a sketch brackets each quantile, then readings are counted, one by one inside the brackets (under
    1 % of a large group for each quantile) and as one number per gap outside. Only those counts are shuffled; positions are found
    among them with two-level running counts, so no group is gathered in one task.
    """
    counts = written(bracket_counts(df, by, value, probs), "brackets")
    placed = running(with_range_bucket(counts, "_at", buckets=buckets), by, ["_slot", F.asc_nulls_first("_v")], {"_upto": ("sum", F.col("_c"))}, whole=True)
    return _picks(placed, by, probs, nearest_rank)
