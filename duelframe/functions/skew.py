"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.session import shuffle_width

_SALT = "__salt"
_KEY = "__hot_key"
_LEAST_TRACKED, _MOST_TRACKED = 10_000, 1_000_000


def _key_hash(on: Sequence[str]):
    return F.xxhash64(*[F.col(f"`{name}`") for name in on])


def hot_key_hashes(df: DataFrame, on: Sequence[str], *, share: float | None = None) -> list[int]:
    """Hashes of all keys holding more than `share` of the rows: 1 / share of them at most.

    One pass over the key columns with a top-k sketch as large as that number, so the
    result is small however many keys there are. An error in the sketch changes only the balance
    of the join, never its rows.
    """
    share = share or 1.0 / (4 * shuffle_width(df.sparkSession))
    most = int(1.0 / share) + 1
    tracked = min(_MOST_TRACKED, max(_LEAST_TRACKED, 8 * most))
    row = (
        df.select(_key_hash(on).alias(_KEY))
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({_KEY}, {min(most, tracked)}, {tracked})").alias("top"))
        .first()
    )
    floor = max(1.0, row["n"] * share)
    return [item["item"] for item in (row["top"] or []) if item["count"] > floor and item["count"] > 1]


def scattered(key, *spread_by):
    """A text key whose nulls are spread by other columns; what stands for a null equals no key."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*spread_by).cast("string")))


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    spread_by: Sequence[str],
    hot: Sequence[int] | None = None,
    salts: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Join a big side with a lookup side, spreading hot keys over many tasks.

    Rows of hot keys get a salt from `spread_by`; only the lookup rows of those
    few keys are repeated. All other keys keep salt 0 on both sides.
    """
    hot = hot_key_hashes(left, on) if hot is None else list(hot)
    if not hot:
        return left.join(right, list(on), how)
    salts = salts or 4 * shuffle_width(left.sparkSession)
    is_hot = _key_hash(on).isin(*hot)
    salt_of_row = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), F.lit(salts)).cast("int")
    salted_left = left.withColumn(_SALT, F.when(is_hot, salt_of_row).otherwise(F.lit(0)))
    salted_right = right.withColumn(
        _SALT,
        F.explode(
            F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)
