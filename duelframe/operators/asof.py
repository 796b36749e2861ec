"""Strict point-in-time join: the latest snapshot dated before the reference date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.skew import salted_lookup, scattered
from duelframe.functions.values import finite_or_null

OK, UNKNOWN, UNAVAILABLE, DUPLICATE = "ok", "not_found", "snapshot_unavailable", "duplicate_snapshot"


def strict_asof(
    requests: DataFrame,
    snapshots: DataFrame,
    *,
    entity_id: str = "entity_id",
    reference: str = "ref_date",
    snapshot_id: str = "entity_id",
    as_of: str = "as_of",
    out: str = "snapshot",
    spread_by: Sequence[str] = (),
    repeats: str | None = None,
) -> DataFrame:
    """Requests with the chosen snapshot as a struct, its status and the available dates.

    Two steps. The first looks at ids and days only: snapshots of entities that nobody asks for are dropped before
    anything is dealt, both sides are reduced to one row per entity and calendar day with map-side sums, and a window
    over (id, day, count) finds the day that each request gets. What the window sees per entity is bounded by the
    calendar, however many requests or repeated snapshots an entity has. The second fetches the whole rows of
    the chosen (id, day) pairs, so wide rows never enter a window or an aggregate. The answers join back on
    (entity, day); with `spread_by`, requests of a very common (entity, day) are salted over many tasks.

    With `repeats`, a struct of that name holds the number of rows on a date that is there more than once, and the date.

    Status is `ok`, `not_found`, `snapshot_unavailable` or `duplicate_snapshot`. Only
    repeats on the selected date count as duplicates. Snapshots on the reference
    date itself are never used.
    """
    asked = (
        requests.select(F.col(entity_id).alias("__id"), F.col(reference).cast("date").alias("__day"))
        .where("__id IS NOT NULL AND __day IS NOT NULL")
        .distinct()
    )
    dated_ids = snapshots.select(F.col(snapshot_id).alias("__id"), F.col(as_of).cast("date").alias("__day"))
    per_day = dated_ids.join(asked.select("__id").distinct(), "__id", "left_semi").groupBy("__id", "__day").agg(F.count(F.lit(1)).alias("__n"))
    timeline = per_day.withColumn("__kind", F.lit(1)).unionByName(asked.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    # requests sort before snapshots of the same day, which keeps the join strict
    upto = Window.partitionBy("__id").orderBy(F.asc_nulls_first("__day"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("__id")
    is_snapshot = F.col("__kind") == 1
    dated = is_snapshot & F.col("__day").isNotNull()
    hit = F.last(F.when(dated, F.struct("__n", "__day")), ignorenulls=True).over(upto)
    found = (
        timeline.select(
            "__id", "__day", "__kind",
            hit.alias("__hit"),
            F.min(F.when(dated, F.col("__day"))).over(whole).alias("available_first"),
            F.max(F.when(dated, F.col("__day"))).over(whole).alias("available_last"),
            F.max("__kind").over(whole).alias("__known"),
        )
        .where("__kind = 0")
        .select(
            "__id", "__day", "available_first", "available_last",
            F.when(F.col("__known") == 0, F.lit(UNKNOWN))
            .when(F.col("__hit").isNull(), F.lit(UNAVAILABLE))
            .when(F.col("__hit.__n") > 1, F.lit(DUPLICATE))
            .otherwise(F.lit(OK))
            .alias("snapshot_status"),
            # only a date with one row is looked up
            F.when(F.col("__hit.__n") == 1, F.col("__hit.__day")).alias("__taken"),
            *([F.when(F.col("__hit.__n") > 1, F.struct(F.col("__hit.__n").alias("n"), F.col("__hit.__day").alias("day"))).alias(repeats)] if repeats else []),
        )
    )
    taken = found.where("__taken IS NOT NULL").select("__id", "__taken").distinct()
    rows = snapshots.select(F.col(snapshot_id).alias("__id"), F.col(as_of).cast("date").alias("__taken"), F.struct("*").alias(out))
    answers = found.join(rows.join(taken, ["__id", "__taken"], "left_semi"), ["__id", "__taken"], "left").drop("__taken")
    id_of = F.col(entity_id)
    if dict(requests.dtypes)[entity_id] == "string":
        plain = [c for c, kind in requests.dtypes if kind in ("string", "date", "timestamp", "bigint", "int")]
        id_of = scattered(id_of, *[F.col(f"`{c}`") for c in plain])
    keyed = requests.withColumns({"__id": id_of, "__day": F.col(reference).cast("date")})
    keys = ["__id", "__day"]
    joined = salted_lookup(keyed, answers, keys, spread_by=spread_by) if spread_by else keyed.join(answers, keys, "left")
    return joined.drop(*keys).withColumn("snapshot_status", F.coalesce("snapshot_status", F.lit(UNKNOWN)))


def refreshed_values(
    reference: Column,
    *,
    dob: Column,
    last_event: Column,
    stored_age: Column,
    activity: dict[str, Column],
    default_layoff_days: int = fv.DEFAULT_LAYOFF_DAYS,
) -> dict[str, Column]:
    """Date-driven fields moved to the reference date.

    Age comes from the birth date; without one the stored age stays and the missing
    flag is set. Layoff counts days since the last event. An activity window is
    zeroed only when the layoff proves it empty. `refresh_error` is null when all is well.
    """
    if default_layoff_days < 0:
        raise ValueError("default_layoff_days cannot be negative")
    age = F.when(dob.isNotNull(), F.datediff(reference, dob) / fv.DAYS_PER_YEAR).otherwise(finite_or_null(stored_age))
    layoff = F.datediff(reference, last_event)
    error = (
        F.when(dob >= reference, F.lit("birth_not_before_reference"))
        .when(age.isNull(), F.lit("age_missing"))
        .when(layoff < 0, F.lit("event_after_reference"))
    )
    known_layoff = F.coalesce(layoff, F.lit(default_layoff_days))
    out = {
        "feature_age_years": age,
        "feature_age_missing": F.when(dob.isNotNull(), F.lit(0.0)).otherwise(F.lit(1.0)),
        "feature_log_layoff_days": F.log1p(F.greatest(known_layoff, F.lit(0)).cast("double")),
        "layoff_days": layoff,
        "refresh_error": error,
    }
    for name, days in fv.ACTIVITY_WINDOWS:
        if name in activity:
            out[name] = F.when(last_event.isNull() | (layoff > days), F.lit(0.0)).otherwise(activity[name])
    return out


def days_after_cutoff(reference: Column, cutoff: str | None) -> Column:
    """Days by which the reference date passes the cutoff, never negative."""
    if cutoff is None:
        return F.lit(0)
    return F.greatest(F.lit(0), F.datediff(reference, F.lit(cutoff).cast("date")))


def post_cutoff_error(reference: Column, cutoff: str | None, allowed: bool) -> Column:
    if cutoff is None or allowed:
        return F.lit(None).cast("string")
    return F.when(reference > F.lit(cutoff).cast("date"), F.lit("post_cutoff_disabled"))
