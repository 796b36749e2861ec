"""Dates, numbers, links and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import col, is_blank, strip


def iso_date(value: Column | str) -> Column:
    """Date from a date, timestamp or ISO text (first ten characters); null when unusable."""
    head = F.substring(strip(col(value).cast("string")), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")).when(
        head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd")
    )


def is_finite(value: Column | str) -> Column:
    number = col(value)
    return F.coalesce(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), F.lit(False))


def finite_or_null(value: Column | str) -> Column:
    number = col(value)
    return F.when(is_finite(number), number)


def number_or(value: Column | str, default: float | None = None) -> Column:
    """Double from a number or text. Null, blank and non-finite become the default.

    Text that is no number stays null even with a default: see `bad_number`.
    """
    raw = col(value)
    number = finite_or_null(raw.try_cast("double"))
    if default is None:
        return number
    return F.when(bad_number(raw), F.lit(None).cast("double")).otherwise(
        F.coalesce(number, F.lit(float(default)))
    )


def bad_number(value: Column | str) -> Column:
    """Non-blank text that does not parse as a number."""
    raw = col(value)
    return ~is_blank(raw.cast("string")) & raw.try_cast("double").isNull()


def count_value(value: Column | str) -> Column:
    """Count rounded half to even, missing counted as zero."""
    return F.bround(number_or(value, 0.0), 0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def sigmoid(score: Column | str) -> Column:
    """Logistic link with the score clipped to what a double exponent can hold."""
    return 1.0 / (1.0 + F.exp(-clip(col(score), -709.0, 709.0)))


def logit(probability: Column | str, epsilon: float = fv.LOGIT_EPSILON) -> Column:
    clipped = clip(col(probability), epsilon, 1.0 - epsilon)
    return F.log(clipped / (1.0 - clipped))


def row_log_loss(target: Column, probability: Column) -> Column:
    p = clip(probability, fv.LOG_LOSS_EPSILON, 1.0 - fv.LOG_LOSS_EPSILON)
    return F.when(target == 1, -F.log(p)).otherwise(-F.log(1.0 - p))


def experience_band(count: Column | str) -> Column:
    """Band of a history count; null for a missing, negative or non-finite count."""
    number = col(count).cast("double")
    # a fraction between two bands falls through to the open band
    chain = F.when(number == 0, F.lit(fv.EXPERIENCE_BANDS[0][0]))
    low = 1
    for label, high in fv.EXPERIENCE_BANDS[1:-1]:
        chain = chain.when((number >= low) & (number <= high), F.lit(label))
        low = high + 1
    return F.when(is_finite(number) & (number >= 0), chain.otherwise(F.lit(fv.EXPERIENCE_BANDS[-1][0])))


def pair_experience_band(first: Column | str, second: Column | str) -> Column:
    a, b = col(first).cast("double"), col(second).cast("double")
    return F.when(is_finite(a) & is_finite(b), experience_band(F.least(a, b)))


def probability_band(probability: Column | str) -> Column:
    """Band of the larger of p and 1 - p; null outside [0, 1]."""
    p = col(probability)
    strength = F.greatest(p, 1.0 - p)
    chain = F
    for label, high in fv.PROBABILITY_BANDS[:-1]:
        chain = chain.when(strength < high, F.lit(label))
    return F.when(is_finite(p) & p.between(0.0, 1.0), chain.otherwise(F.lit(fv.PROBABILITY_BANDS[-1][0])))


def linear_score(weights: dict[str, float], intercept: float = 0.0, prefix: str = "") -> Column:
    """Weighted sum of columns, added in the given order."""
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(f"{prefix}`{name}`" if prefix else f"`{name}`")
    return total
