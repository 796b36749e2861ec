"""Data-quality checks. Each returns findings as rows instead of stopping the job.

A findings row is `(check, column, bad_count, examples)`. Counting is done with
map-side sums; at most ten examples per check leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe import fixed_values as fv
from duelframe.functions.text import parse_bool
from duelframe.functions.values import is_finite

FINDING = "check string, column string, bad_count bigint, examples array<string>"
_NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DecimalType, T.BooleanType,
)


class DataCheckError(ValueError):
    """Raised by `assert_valid` with every finding in the message."""


def combine(findings: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def assert_valid(findings: DataFrame) -> None:
    # findings are one row per (check, column) by construction
    rows = findings.where("bad_count > 0").collect()
    if rows:
        text = "; ".join(f"{r['check']}({r['column']}): {r['bad_count']} {list(r['examples'] or [])}" for r in rows)
        raise DataCheckError(text)


def metadata_findings(spark: SparkSession, check: str, names: Sequence[str]) -> DataFrame:
    """Findings known from the schema alone; no job runs."""
    rows = [(check, name, 1, []) for name in names]
    return spark.createDataFrame(rows, FINDING)


def column_counts(df: DataFrame, check: str, conditions: dict[str, Column]) -> DataFrame:
    """Number of rows meeting each condition: one pass over the table, one row per column."""
    if not conditions:
        return df.sparkSession.createDataFrame([], FINDING)
    names = list(conditions)
    one_row = df.agg(*[F.count_if(conditions[n]).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("bad_count")) for i, n in enumerate(names)])
    return one_row.select(F.explode(pairs).alias("f")).select(
        F.lit(check).alias("check"), "f.column", "f.bad_count",
        F.array().cast("array<string>").alias("examples"),
    )


def row_checks(df: DataFrame, checks: Sequence[tuple[str, str, Column, Column]], *, limit: int = 10) -> DataFrame:
    """(check, column, bad, example) conditions over one scan: count of bad rows and the first examples in text order.

    Only bad cells leave the tasks, summed by value. The ranked limit keeps `limit` values a task and check.
    """
    named = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(check).alias("check"), F.lit(column).alias("column")) for i, (check, column, _, _) in enumerate(checks)])
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), bad.alias("bad"), example.cast("string").alias("example")) for i, (_, _, bad, example) in enumerate(checks)]
    )
    values = df.select(F.inline(F.filter(cells, lambda c: c["bad"]))).groupBy("i", "example").agg(F.count(F.lit(1)).alias("n"))
    totals = values.groupBy("i").agg(F.sum("n").alias("bad_count"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("example")))
    few = ranked.where(F.col("rank") <= limit).groupBy("i").agg(F.sort_array(F.collect_list("example")).alias("examples"))
    return (
        df.sparkSession.range(1)
        .select(F.inline(named))
        .join(totals, "i", "left")
        .join(few, "i", "left")
        .select("check", "column", F.coalesce("bad_count", F.lit(0)).cast("bigint").alias("bad_count"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
    )


def row_check(df: DataFrame, check: str, column: str, bad: Column, example: Column, *, limit: int = 10) -> DataFrame:
    """One condition of `row_checks`."""
    return row_checks(df, [(check, column, bad, example)], limit=limit)


def _with_examples(counted: DataFrame, wrong: DataFrame, check: str, column: str, limit: int) -> DataFrame:
    # the ordered limit keeps `limit` rows per task and merges those only
    few = wrong.distinct().orderBy("example").limit(limit).select(
        F.lit(None).cast("bigint").alias("bad_count"), "example"
    )
    both = counted.select("bad_count", F.lit(None).cast("string").alias("example")).unionByName(few)
    return both.agg(
        F.coalesce(F.max("bad_count"), F.lit(0)).alias("bad_count"),
        F.sort_array(F.collect_list("example")).alias("examples"),
    ).select(F.lit(check).alias("check"), F.lit(column).alias("column"), "bad_count", "examples")


# --- schema -----------------------------------------------------------------------


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def required_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    return metadata_findings(df.sparkSession, "missing_column", missing_columns(df, required))


def leak_names(names: DataFrame, column: str, *, target: str) -> DataFrame:
    """Rows of a table of column names that would leak the outcome."""
    word = F.lower(F.trim(F.col(column).cast("string")))
    by_pattern = reduce(lambda a, b: a | b, [word.rlike(p) for p in fv.LEAK_PATTERNS])
    leaks = word.startswith(fv.LEAK_TARGET_PREFIX) | word.isin(*fv.LEAK_NAMES) | by_pattern
    return names.where((word != target.lower()) & leaks)


def leak_columns(df: DataFrame, *, target: str) -> DataFrame:
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return leak_names(names, "column", target=target).select(
        F.lit("leak_column").alias("check"), "column", F.lit(1).cast("bigint").alias("bad_count"),
        F.array().cast("array<string>").alias("examples"),
    )


# --- contest table ------------------------------------------------------------------


def null_counts(df: DataFrame, columns: Sequence[str], check: str = "null_value") -> DataFrame:
    return column_counts(df, check, {c: F.col(f"`{c}`").isNull() for c in columns})


def duplicate_keys(df: DataFrame, keys: Sequence[str], *, check: str = "duplicate_key", limit: int = 10) -> DataFrame:
    """Rows sharing their key with another row, every member counted."""
    parts = [F.col(f"`{k}`").cast("string") for k in keys]
    repeated = df.groupBy(*[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wrong = repeated.select("n", F.concat_ws("|", *parts).alias("example"))
    counted = wrong.agg(F.sum("n").alias("bad_count"))
    return _with_examples(counted, wrong.select("example"), check, "|".join(keys), limit)


def self_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    left, right = F.col(a).cast("string"), F.col(b).cast("string")
    return row_check(df, "self_pair", a, left == right, left)


def binary_target(df: DataFrame, target: str) -> DataFrame:
    """Nulls, text that is no number, values outside {0, 1}, and an absent class."""
    raw = F.col(f"`{target}`")
    number = raw.try_cast("double")
    one_row = df.agg(
        F.count_if(raw.isNull()).alias("target_null"),
        F.count_if(raw.isNotNull() & number.isNull()).alias("target_not_numeric"),
        F.count_if(number.isNotNull() & ~number.isin(0.0, 1.0)).alias("target_not_binary"),
        F.count_if(number == 0).alias("zeros"),
        F.count_if(number == 1).alias("ones"),
    )
    one_class = (F.when(F.col("zeros") == 0, 1).otherwise(0) + F.when(F.col("ones") == 0, 1).otherwise(0)).cast("bigint")
    checks = F.array(
        *[
            F.struct(F.lit(name).alias("check"), count.alias("bad_count"))
            for name, count in (
                ("target_null", F.col("target_null")),
                ("target_not_numeric", F.col("target_not_numeric")),
                ("target_not_binary", F.col("target_not_binary")),
                ("target_class_absent", one_class),
            )
        ]
    )
    return one_row.select(F.explode(checks).alias("f")).select(
        "f.check", F.lit(target).alias("column"), "f.bad_count", F.array().cast("array<string>").alias("examples")
    )


def feature_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Non-numeric columns from the schema; null and non-finite counts in one pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in features if not isinstance(types[c], _NUMERIC)]
    numeric = [c for c in features if c not in text]
    number = {c: F.col(f"`{c}`").cast("double") for c in numeric}
    conditions = {}
    for c in numeric:
        conditions[("feature_null", c)] = number[c].isNull() | F.isnan(number[c])
        conditions[("feature_not_finite", c)] = F.abs(number[c]) == float("inf")
    one_row = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, cond in enumerate(conditions.values())]) if conditions else None
    parts = [metadata_findings(df.sparkSession, "feature_not_numeric", text)]
    if one_row is not None:
        pairs = F.array(
            *[
                F.struct(F.lit(check).alias("check"), F.lit(c).alias("column"), F.col(f"c{i}").alias("bad_count"))
                for i, (check, c) in enumerate(conditions)
            ]
        )
        parts.append(
            one_row.select(F.explode(pairs).alias("f")).select("f.*", F.array().cast("array<string>").alias("examples"))
        )
    return combine(parts)


def expected_counts(df: DataFrame, features: Sequence[str], *, rows: int | None, feature_count: int | None) -> DataFrame:
    """Distance from the expected row and feature counts; None disables a check."""
    conditions = [F.struct(F.lit("feature_count").alias("check"), F.abs(F.lit(len(features)) - F.lit(feature_count)).cast("bigint").alias("bad_count"))] if feature_count is not None else []
    if rows is not None:
        conditions.append(F.struct(F.lit("row_count").alias("check"), F.abs(F.col("n") - F.lit(rows)).alias("bad_count")))
    if not conditions:
        return df.sparkSession.createDataFrame([], FINDING)
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*conditions)).alias("f")).select(
        "f.check", F.lit("*").alias("column"), "f.bad_count", F.array().cast("array<string>").alias("examples")
    )


def after_cutoff(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    return row_check(df, "after_cutoff", date, F.col(date) > F.lit(cutoff).cast("date"), F.col(date))


def dataset_evidence(df: DataFrame, *, target: str, date: str, features: Sequence[str]) -> DataFrame:
    """One row of counts and date bounds for a table that passed the checks."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(features)).cast("int").alias("feature_count"),
        F.count_if(F.col(target) == 1).alias("positive_count"),
        F.count_if(F.col(target) == 0).alias("negative_count"),
        F.min(date).alias("first_event_date"),
        F.max(date).alias("last_event_date"),
    )


# --- feature dictionary -----------------------------------------------------------------


def dictionary_findings(dictionary: DataFrame, *, target: str, expected: int | None = None) -> DataFrame:
    """Target row, availability, duplicate names, expected count and leaking names."""
    column, role = F.col("column").cast("string"), F.col("role").cast("string")
    available = parse_bool("available_pre_fight")
    feature, is_target = role == fv.FEATURE_ROLE, column == target
    one_row = dictionary.agg(
        F.count_if(column.isNull()).alias("null_name"),
        F.count_if(is_target).alias("target_rows"),
        F.count_if(is_target & (role != fv.TARGET_ROLE)).alias("target_role"),
        F.count_if(is_target & available).alias("target_available"),
        F.count_if((feature | is_target) & available.isNull()).alias("bad_boolean"),
        F.count_if(feature & ~available).alias("feature_unavailable"),
        F.count_if(feature).alias("features"),
    )
    checks = {
        "null_name": F.col("null_name"),
        "target_not_once": F.abs(F.col("target_rows") - 1),
        "target_role": F.col("target_role"),
        "target_available": F.col("target_available"),
        "bad_boolean": F.col("bad_boolean"),
        "feature_unavailable": F.col("feature_unavailable"),
        "no_features": F.when(F.col("features") == 0, 1).otherwise(0).cast("bigint"),
    }
    if expected is not None:
        checks["feature_count"] = F.abs(F.col("features") - expected)
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("bad_count")) for k, v in checks.items()])
    counted = one_row.select(F.explode(pairs).alias("f")).select(
        "f.check", F.lit("column").alias("column"), "f.bad_count", F.array().cast("array<string>").alias("examples")
    )
    names = dictionary.where(feature).select("column")
    leaks = leak_names(names, "column", target=target)
    return combine(
        [
            counted,
            duplicate_keys(dictionary.where(column.isNotNull()), ["column"], check="duplicate_name"),
            row_check(leaks, "leak_column", "column", F.lit(True), F.col("column")),
        ]
    )


# --- snapshot table -----------------------------------------------------------------------


def strict_dates(df: DataFrame, column: str, parsed: Column, *, allow_null: bool) -> DataFrame:
    """Unparseable and null dates, counted apart."""
    raw = F.col(f"`{column}`")
    unusable = row_check(df, "date_unparseable", column, raw.isNotNull() & parsed.isNull(), raw)
    if allow_null:
        return unusable
    return combine([unusable, column_counts(df, "date_null", {column: raw.isNull()})])


def common_as_of(df: DataFrame, as_of: str, *, expected: str | None = None) -> DataFrame:
    """Extra as-of dates beyond the first, and distance from the expected date."""
    days = df.groupBy(F.col(as_of).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # one row per calendar day from here on
    summary = days.agg(F.count(F.lit(1)).alias("dates"), F.min("day").alias("first"), F.max("day").alias("last"))
    checks = [F.struct(F.lit("as_of_not_common").alias("check"), (F.col("dates") - 1).alias("bad_count"))]
    if expected is not None:
        wanted = F.lit(expected).cast("date")
        off = (F.col("first") != wanted) | (F.col("last") != wanted)
        checks.append(F.struct(F.lit("as_of_not_expected").alias("check"), F.when(off, 1).otherwise(0).cast("bigint").alias("bad_count")))
    return summary.select(F.explode(F.array(*checks)).alias("f")).select(
        "f.check", F.lit(as_of).alias("column"), "f.bad_count", F.array().cast("array<string>").alias("examples")
    )


def later_than(df: DataFrame, column: str, as_of: str, key: str, *, check: str) -> DataFrame:
    example = F.concat_ws("|", F.col(key).cast("string"), F.col(column).cast("string"))
    return row_check(df, check, column, F.col(column) > F.col(as_of), example)


def snapshot_evidence(df: DataFrame, *, as_of: str, last_event: str, features: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("entity_count"),
        F.lit(len(features)).cast("int").alias("feature_count"),
        F.max(as_of).alias("as_of_date"),
        F.max(last_event).alias("last_recorded_event_date"),
    )


def id_set_difference(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Ids present on one side only. One shuffle of ids already summed per task."""
    sides = left.select(F.col(left_id).cast("string").alias("id"), F.lit(1).alias("in_left"), F.lit(0).alias("in_right"))
    other = right.select(F.col(right_id).cast("string").alias("id"), F.lit(0).alias("in_left"), F.lit(1).alias("in_right"))
    return (
        sides.unionByName(other)
        .groupBy("id")
        .agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
        .where("in_left + in_right = 1")
        .select("id", F.when(F.col("in_left") == 1, "missing_right").otherwise("missing_left").alias("finding"))
    )


def id_set_findings(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    difference = id_set_difference(left, right, left_id, right_id)
    return combine(
        [
            row_check(difference, side, left_id, F.col("finding") == side, F.col("id"))
            for side in ("missing_left", "missing_right")
        ]
    )


# --- whole-table checks ---------------------------------------------------------------------


def contest_findings(
    df: DataFrame,
    features: Sequence[str],
    *,
    columns: fv.Columns = fv.Columns(),
    cutoff: str,
    expected_rows: int | None = None,
    expected_features: int | None = None,
) -> DataFrame:
    """Every check of the contest table."""
    c = columns
    missing = missing_columns(df, [*c.contest_required, *features])
    if missing:
        return metadata_findings(df.sparkSession, "missing_column", missing)
    return combine(
        [
            leak_columns(df, target=c.target),
            expected_counts(df, features, rows=expected_rows, feature_count=expected_features),
            null_counts(df, c.contest_required),
            duplicate_keys(df, [c.contest_id]),
            self_pairs(df, c.a_id, c.b_id),
            binary_target(df, c.target),
            feature_matrix(df, features),
            after_cutoff(df, c.event_date, cutoff),
        ]
    )


def snapshot_findings(
    df: DataFrame,
    features: Sequence[str],
    *,
    columns: fv.Columns = fv.Columns(),
    expected_cutoff: str | None = None,
    single_date: bool = True,
) -> DataFrame:
    """Every check of the snapshot table.

    `single_date` demands one common as-of date and unique ids; without it the
    table may hold several dates per entity, unique on (id, date).
    """
    c = columns
    missing = missing_columns(df, [*c.snapshot_required, *features])
    if missing:
        return metadata_findings(df.sparkSession, "missing_column", missing)
    keys = [c.entity_id] if single_date else [c.entity_id, c.as_of]
    parts = [
        column_counts(df, "empty_table", {}) if df.take(1) else metadata_findings(df.sparkSession, "empty_table", ["*"]),
        null_counts(df, [c.entity_id, c.entity_name, c.as_of]),
        duplicate_keys(df, keys),
        later_than(df, c.last_event, c.as_of, c.entity_id, check="event_after_as_of"),
        leak_columns(df, target=c.target),
        feature_matrix(df, features),
    ]
    if single_date:
        parts.append(common_as_of(df, c.as_of, expected=expected_cutoff))
    if c.dob in df.columns:
        parts.append(later_than(df, c.dob, c.as_of, c.entity_id, check="birth_after_as_of"))
    return combine(parts)
