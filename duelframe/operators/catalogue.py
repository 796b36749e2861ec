"""Feature catalogue: the ordered, grouped list of model features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import col, parse_bool, strip
from duelframe.operators.quality import DataCheckError


def _has_any(word: Column, tokens: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [word.contains(token) for token in tokens])


def feature_group(name: Column | str) -> Column:
    """Semantic group by bare substring, first matching rule wins."""
    word = F.lower(col(name))
    chain = F
    for group, tokens in fv.FEATURE_GROUP_RULES:
        chain = chain.when(_has_any(word, tokens), F.lit(group))
    return chain.otherwise(F.lit(fv.FEATURE_GROUP_OTHER))


def catalogue_from_dictionary(dictionary: DataFrame, position: str = "position") -> DataFrame:
    """Feature rows in canonical order with their group and availability."""
    return dictionary.where(F.col("role").cast("string") == fv.FEATURE_ROLE).select(
        F.col(position).alias("position"),
        strip("column").alias("feature"),
        feature_group(strip("column")).alias("feature_group"),
        parse_bool("available_pre_fight").alias("available"),
        F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description"),
    )


def feature_names(catalogue: DataFrame) -> list[str]:
    """Canonical names. A feature list is as long as a table is wide, so it fits the driver."""
    rows = catalogue.select("position", "feature").collect()
    names = [r["feature"] for r in sorted(rows, key=lambda r: r["position"])]
    if not names:
        raise DataCheckError("the feature catalogue is empty")
    if len(set(names)) != len(names):
        raise DataCheckError("the feature catalogue holds duplicate names")
    return names


def discover_features(df: DataFrame, prefix: str = "feature_", exclude: Sequence[str] = ()) -> list[str]:
    """Columns with the prefix, in text order."""
    names = sorted(c for c in df.columns if c.startswith(prefix) and c not in set(exclude))
    if not names:
        raise DataCheckError(f"no feature columns with prefix {prefix!r}")
    return names


def catalogue_from_names(spark: SparkSession, names: Sequence[str], description: str = "Discovered model feature") -> DataFrame:
    rows = [(i, n, True, description) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "position int, feature string, available boolean, description string")
    return frame.select("position", "feature", feature_group("feature").alias("feature_group"), "available", "description")


def name_mismatch(expected: DataFrame, actual: DataFrame, column: str = "feature") -> DataFrame:
    """Names on one side only: `missing` from the table or `unexpected` in it."""
    sides = expected.select(F.col(column).alias("feature"), F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        actual.select(F.col(column).alias("feature"), F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    both = sides.groupBy("feature").agg(F.max("e").alias("e"), F.max("a").alias("a"))
    return both.where("e + a = 1").select(
        "feature", F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("finding")
    )


def assert_features_match(df: DataFrame, names: Sequence[str], prefix: str = "feature_") -> None:
    actual = {c for c in df.columns if c.startswith(prefix)}
    missing, unexpected = sorted(set(names) - actual), sorted(actual - set(names))
    if missing or unexpected:
        raise DataCheckError(f"features do not match; missing={missing}, unexpected={unexpected}")


def select_matrix(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns as doubles in canonical order; only these reach the scan."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataCheckError(f"missing features: {missing}")
    return df.select(*keep, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])


def group_sizes(catalogue: DataFrame) -> DataFrame:
    """Feature count and first position of every group."""
    return catalogue.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("features"), F.min("position").alias("first_position")
    )


def group_members(catalogue: DataFrame) -> DataFrame:
    """Members of every group in canonical order.

    One row per (group, feature): a group list is bounded only by the width of
    the feature table, so it stays a column of rows rather than one array.
    """
    in_group = Window.partitionBy("feature_group").orderBy("position")
    return catalogue.select("feature_group", (F.row_number().over(in_group) - 1).alias("rank_in_group"), "position", "feature")


def ablation_members(catalogue: DataFrame) -> DataFrame:
    """(ablation group, feature) pairs; a feature may be in several groups."""
    word = F.lower(F.col("feature"))
    tags = []
    for group, include, exclude in fv.ABLATION_RULES:
        hit = _has_any(word, include)
        if exclude:
            hit = hit & ~_has_any(word, exclude)
        tags.append(F.when(hit, F.lit(group)))
    hits = F.filter(F.array(*tags), lambda tag: tag.isNotNull())
    return catalogue.select(F.explode(hits).alias("ablation_group"), "position", "feature")


def ablation_groups(spark: SparkSession, names: Sequence[str]) -> dict[str, list[str]]:
    """Ablation groups of a feature list, empty groups left out."""
    rows = ablation_members(catalogue_from_names(spark, names)).collect()
    found: dict[str, list[str]] = {group: [] for group, _, _ in fv.ABLATION_RULES}
    for row in sorted(rows, key=lambda r: r["position"]):
        found[row["ablation_group"]].append(row["feature"])
    return {group: members for group, members in found.items() if members}


def catalogue_digest(catalogue: DataFrame) -> DataFrame:
    """SHA-256 of the ordered contract: name, group, availability."""
    line = F.concat(
        F.col("feature"), F.lit("\x1f"), F.col("feature_group"), F.lit("\x1f"),
        F.col("available").cast("int").cast("string"), F.lit("\x1e"),
    )
    # as many rows as there are feature columns
    ordered = F.sort_array(F.collect_list(F.struct("position", line.alias("line"))))
    return catalogue.agg(
        F.sha2(F.array_join(F.transform(ordered, lambda s: s["line"]), ""), 256).alias("catalogue_sha256")
    )


def training_ranges(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Smallest and largest value per feature: one pass, one row per feature."""
    one_row = df.agg(
        *[F.min(F.col(f"`{n}`").cast("double")).alias(f"lo{i}") for i, n in enumerate(names)],
        *[F.max(F.col(f"`{n}`").cast("double")).alias(f"hi{i}") for i, n in enumerate(names)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
            for i, n in enumerate(names)
        ]
    )
    return one_row.select(F.explode(pairs).alias("r")).select("r.*")


def ranges_to_dict(ranges: DataFrame) -> dict[str, tuple[float, float]]:
    """Range table as literals for a plan: one entry per feature column."""
    found = {r["feature"]: (r["lo"], r["hi"]) for r in ranges.collect() if r["lo"] is not None and r["hi"] is not None}
    bad = [n for n, (lo, hi) in found.items() if lo > hi]
    if bad:
        raise ValueError(f"invalid training range for {bad}")
    return found
