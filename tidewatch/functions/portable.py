"""Expressions whose values do not depend on partitioning, engine or session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def order_key(seed: int | str | Column, *ids) -> Column:
    """Seeded random order as a string key: md5 of ``seed:id``. A seed may differ from row to row."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first, *[_c(i).cast("string") for i in ids]))


def uniform(seed: int | str | Column, *ids) -> Column:
    """Seeded uniform number in [0, 1), from the first 32 bits of the order key."""
    return F.conv(F.substring(order_key(seed, *ids), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def key_bucket(key: Column | str, bits: int = 16) -> Column:
    """Range bucket of an order key: its first ``bits`` bits. Monotone in the key, evenly filled."""
    head = F.conv(F.substring(_c(key), 1, 8), 16, 10).cast("bigint")
    # Never null, so that joins on the bucket need no null filter that would hash every row twice.
    return F.coalesce(F.shiftright(head, 32 - bits).cast("int"), F.lit(0))


def ratio(numerator, denominator) -> Column:
    """Division that gives 0.0 on a zero or null denominator."""
    return F.coalesce(F.try_divide(_n(numerator), _n(denominator)), F.lit(0.0))


def reading(value) -> Column:
    """A number as DOUBLE, NaN as null: Spark holds NaN for larger than any number."""
    return F.nanvl(_n(value), F.lit(None).cast("double"))


def clip01(value) -> Column:
    return F.least(F.greatest(_n(value), F.lit(0.0)), F.lit(1.0))


def lenient_long(value) -> Column:
    """Number or numeric text to BIGINT, truncating; anything else is 0."""
    return F.coalesce(_c(value).cast("string").try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def lenient_int(value) -> Column:
    """Number or numeric text to INT, truncating; anything else is -1."""
    return F.coalesce(_c(value).cast("string").try_cast("double").try_cast("int"), F.lit(-1))


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})")


def seconds_to_timestamp(seconds) -> Column:
    """Zone-free timestamp of a number of seconds since 1970."""
    return F.timestamp_add("MICROSECOND", F.round(_n(seconds) * 1000000).cast("bigint"), F.expr(_EPOCH))


def millis_to_timestamp(millis) -> Column:
    """Zone-free timestamp of a number of milliseconds since 1970."""
    return F.timestamp_add("MILLISECOND", _c(millis).cast("bigint"), F.expr(_EPOCH))


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _n(value) -> Column:
    if isinstance(value, (int, float)):
        return F.lit(float(value))
    return _c(value).cast("double")
