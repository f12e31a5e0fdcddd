"""Domain expressions: wavelet, distances, routing, latency, message fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .portable import _c, _n, reading

# Fixed values of the wavelet: prefactor 1 / (sqrt(3) * pi^(1/4)), flag level, unit width.
WAVELET_PREFACTOR = 1.0 / (math.sqrt(3.0) * math.pi**0.25)
WAVELET_FLAG_LEVEL = 0.6


def wavelet(value, amplitude: float = 1.0) -> Column:
    """Mexican-hat response of a reading; ``amplitude`` 2.0 is the usual Ricker scale."""
    v = _n(value)
    return F.lit(amplitude * WAVELET_PREFACTOR) * (F.lit(1.0) - v * v) * F.exp(-(v * v) / F.lit(2.0))


def z_score(value, mean, std) -> Column:
    """Standard score; null when the spread is zero or unknown, or the reading is NaN."""
    return F.try_divide(reading(value) - _n(mean), _n(std))


def distance(a, b) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(squared_distance(a, b))


def squared_distance(a, b) -> Column:
    gaps = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g)


def interpolate(a, b, t) -> Column:
    """The point a share ``t`` of the way from array ``a`` to array ``b``."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + (y - x) * t)


def reconstruction_error(original, rebuilt) -> Column:
    """Mean squared gap between a row and its reconstruction."""
    return squared_distance(original, rebuilt) / F.size(_c(original))


def route(score, anomaly_above: float = 0.8, normal_up_to: float = 0.2,
          names: tuple[str, str, str] = ("anomaly", "normal", "uncertain")) -> Column:
    """Three-way route of a score. Bounds are half open; a null score has no route, NaN is uncertain."""
    s = _n(score)
    return (F.when(F.isnan(s), names[2]).when(s > anomaly_above, names[0]).when(s <= normal_up_to, names[1])
            .when(s.isNotNull(), names[2]))


def latency_ms(event_ms, processed_ms) -> Column:
    """End-to-end latency, never below zero."""
    return F.greatest(F.lit(0).cast("bigint"), (_c(processed_ms) - _c(event_ms)).cast("bigint"))


def json_number(payload, field: str) -> Column:
    return F.get_json_object(_c(payload), f"$.{field}").try_cast("double")


def json_string(payload, field: str) -> Column:
    return F.get_json_object(_c(payload), f"$.{field}")


def number_text(value) -> Column:
    """A reading as message text: whole numbers without decimals, blank or unreadable as null."""
    text = F.trim(_c(value).cast("string"))
    number = text.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(9.0e18))
    return F.when(number.isNull(), None).when(whole, number.cast("decimal(20,0)").cast("string")).otherwise(text)


def json_object(fields: dict[str, Column]) -> Column:
    """One JSON object per row, null fields kept."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def positive_probability(probability) -> Column:
    """P(class 1) of a model's probability vector; 0.0 when absent."""
    from pyspark.ml.functions import vector_to_array

    return F.coalesce(F.get(vector_to_array(_c(probability)), F.lit(1)), F.lit(0.0))


def grouped(features, size: int) -> Column:
    """Flat feature array to an array of ``size``-wide groups; null unless it divides evenly."""
    n = F.size(_c(features))
    groups = F.transform(F.sequence(F.lit(0), (n / size).cast("int") - 1),
                         lambda i: F.slice(_c(features), i * size + 1, size))
    return F.when((n > 0) & (n % size == 0), groups)
