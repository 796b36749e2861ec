"""Names and ids to stable entity ids, as equi-joins on normalised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.skew import scattered
from duelframe.functions.text import blank_to_null, id_key, is_blank, name_key, simple_name_key, strip
from duelframe.functions.values import iso_date

RESOLVED, AMBIGUOUS, NOT_FOUND, INVALID = "resolved", "ambiguous", "not_found", "invalid"


def entity_ids(snapshots: DataFrame, entity_id: str = "fighter_id") -> DataFrame:
    """Distinct stable ids."""
    return snapshots.select(id_key(F.col(entity_id).cast("string")).alias("entity_id")).where("entity_id IS NOT NULL").distinct()


def search_index(
    snapshots: DataFrame,
    *,
    entity_id: str = "fighter_id",
    name: str = "fighter_name",
    display_name: str | None = "display_name",
    ascii_only: bool = False,
) -> DataFrame:
    """Distinct (name_key, entity_id) pairs from names and display names.

    Labels are made distinct before they are normalised, so a snapshot table with
    many dates per entity costs one normalisation per label, not per row.
    """
    label = F.col(name).cast("string")
    labels = F.array(label)
    if display_name and display_name in snapshots.columns:
        labels = F.array(label, F.coalesce(blank_to_null(F.col(display_name).cast("string")), label))
    pairs = (
        snapshots.select(id_key(F.col(entity_id).cast("string")).alias("entity_id"), F.explode(labels).alias("label"))
        .where("entity_id IS NOT NULL AND label IS NOT NULL")
        .distinct()
    )
    return pairs.select(name_key("label", ascii_only=ascii_only).alias("name_key"), "entity_id").where("name_key <> ''").distinct()


def alias_index(aliases: DataFrame, *, alias: str = "alias", target: str = "target", ascii_only: bool = False) -> DataFrame:
    """(name_key, entity_id) pairs of an alias table with one row per target."""
    keyed = aliases.select(
        name_key(alias, ascii_only=ascii_only).alias("name_key"), id_key(F.col(target).cast("string")).alias("entity_id")
    )
    return keyed.where("name_key <> ''").distinct()


def alias_findings(aliases: DataFrame, ids: DataFrame, *, alias: str = "alias", target: str = "target") -> DataFrame:
    """Aliases with an empty key or a target nobody has."""
    keyed = aliases.select(alias, id_key(F.col(target).cast("string")).alias("entity_id"), name_key(alias).alias("name_key"))
    empty = keyed.where("name_key = ''").select(alias, "entity_id", F.lit("empty_alias").alias("finding"))
    unknown = keyed.join(ids, "entity_id", "left_anti").select(alias, "entity_id", F.lit("unknown_target").alias("finding"))
    return empty.unionByName(unknown)


def add_aliases(index: DataFrame, aliases: DataFrame, ids: DataFrame, **names) -> DataFrame:
    """Index with the aliases whose targets exist."""
    known = alias_index(aliases, **names).join(ids, "entity_id", "left_semi")
    return index.unionByName(known.select("name_key", "entity_id")).distinct()


def _key_summary(index: DataFrame) -> DataFrame:
    """Per key the number of entities and, when it is one, which."""
    return index.groupBy("name_key").agg(F.count(F.lit(1)).alias("key_entities"), F.min("entity_id").alias("key_entity"))


def lookup(queries: DataFrame, index: DataFrame, ids: DataFrame, query: str = "query", *, ascii_only: bool = False) -> DataFrame:
    """Resolve each distinct query text: an id first, then a name key.

    Returns query, normalized_query, status, entity_id (when resolved) and the
    number of candidates. The list of candidates is `lookup_candidates`: it is
    kept as rows because a common name may have any number of them.
    """
    asked = queries.select(F.col(query).alias("query")).distinct()
    keyed = _with_keys(asked, ascii_only)
    found = keyed.join(ids.select(F.col("entity_id").alias("possible_id"), F.lit(True).alias("is_id")), "possible_id", "left").join(
        _key_summary(index), "name_key", "left"
    )
    return found.select("query", *_lookup_columns())


def _with_keys(asked: DataFrame, ascii_only: bool) -> DataFrame:
    text = strip("query")
    return asked.select("*", id_key(text).alias("possible_id"), name_key(text, ascii_only=ascii_only).alias("name_key"))


def _lookup_columns() -> list[Column]:
    by_id = F.coalesce(F.col("is_id"), F.lit(False))
    count = F.when(by_id, F.lit(1)).otherwise(F.coalesce("key_entities", F.lit(0))).cast("bigint")
    status = (
        F.when(is_blank("query"), F.lit(INVALID))
        .when(count == 1, F.lit(RESOLVED))
        .when(count > 1, F.lit(AMBIGUOUS))
        .otherwise(F.lit(NOT_FOUND))
    )
    return [
        F.when(by_id, F.col("possible_id")).otherwise(F.col("name_key")).alias("normalized_query"),
        status.alias("status"),
        F.when(by_id, F.col("possible_id")).when(count == 1, F.col("key_entity")).alias("entity_id"),
        count.alias("candidates"),
    ]


def lookup_candidates(looked_up: DataFrame, index: DataFrame) -> DataFrame:
    """One row per (query, candidate id) for resolved and ambiguous queries."""
    single = looked_up.where(F.col("status") == RESOLVED).select("query", "entity_id")
    several = (
        looked_up.where(F.col("status") == AMBIGUOUS)
        .select("query", F.col("normalized_query").alias("name_key"))
        .join(index, "name_key")
        .select("query", "entity_id")
    )
    return single.unionByName(several)


def resolve(
    asked: DataFrame,
    index: DataFrame,
    ids: DataFrame,
    *,
    query: str = "query",
    explicit_id: str | None = None,
    ascii_only: bool = False,
) -> DataFrame:
    """Resolve (query, explicit id) pairs to one entity or one error code.

    An explicit id must exist, and wins when the name matches nothing; a name that
    matches only other entities is an `identity_mismatch`.
    """
    given = F.col(explicit_id).cast("string") if explicit_id else F.lit(None).cast("string")
    pairs = asked.select(F.col(query).alias("query"), given.alias("explicit_id")).distinct()
    keyed = _with_keys(pairs, ascii_only)
    found = keyed.join(ids.select(F.col("entity_id").alias("possible_id"), F.lit(True).alias("is_id")), "possible_id", "left").join(
        _key_summary(index), "name_key", "left"
    )
    out = found.select("query", "explicit_id", "name_key", *_lookup_columns())
    code = (
        F.when(F.col("status") == INVALID, F.lit("invalid_query"))
        .when(F.col("status") == NOT_FOUND, F.lit("not_found"))
        .when(F.col("status") == AMBIGUOUS, F.lit("ambiguous"))
    )
    if not explicit_id:
        return out.select("query", "explicit_id", "status", "entity_id", "candidates", code.alias("error_code"))
    # most queries come without an id: their nulls must not meet in one task
    wanted = out.withColumn("wanted", id_key("explicit_id")).withColumn("__wanted", scattered(F.col("wanted"), "query"))
    checked = wanted.join(
        ids.select(F.col("entity_id").alias("__wanted"), F.lit(True).alias("wanted_known")), "__wanted", "left"
    ).join(
        index.select("name_key", F.col("entity_id").alias("wanted"), F.lit(True).alias("wanted_named")), ["name_key", "wanted"], "left"
    )
    has_id = F.col("explicit_id").isNotNull()
    known = F.coalesce("wanted_known", F.lit(False))
    # a query that is itself an id has that id as its only candidate
    agrees = F.when(
        F.col("status") == AMBIGUOUS, F.coalesce("wanted_named", F.lit(False))
    ).when(F.col("status") == RESOLVED, F.col("entity_id") == F.col("wanted")).otherwise(F.lit(True))
    final_code = (
        F.when(F.col("status") == INVALID, F.lit("invalid_query"))
        .when(has_id & ~known, F.lit("not_found"))
        .when(has_id & ~agrees, F.lit("identity_mismatch"))
        .when(~has_id, code)
    )
    entity = F.when(final_code.isNotNull(), F.lit(None)).when(has_id, F.col("wanted")).otherwise(F.col("entity_id"))
    return checked.select(
        "query", "explicit_id", "status", entity.alias("entity_id"), "candidates", final_code.alias("error_code")
    )


def latest_records(snapshots: DataFrame, *, columns: fv.Columns = fv.Columns()) -> DataFrame:
    """Compact identity record of every entity at its latest date; no date sorts first."""
    c = columns
    optional = lambda name, kind: F.col(name).cast(kind) if name in snapshots.columns else F.lit(None).cast(kind)
    name = strip(F.col(c.entity_name).cast("string"))
    record = F.struct(
        name.alias("entity_name"),
        F.coalesce(blank_to_null(optional(c.display_name, "string")), name).alias("display_name"),
        blank_to_null(optional(c.last_class, "string")).alias("context_class"),
        iso_date(optional(c.dob, "string")).alias("dob"),
        F.col(c.as_of).cast("date").alias("as_of"),
    )
    day = F.coalesce(F.col(c.as_of).cast("date"), F.lit("0001-01-01").cast("date"))
    # the record itself breaks ties, so the result does not depend on row order
    best = F.max(F.struct(day.alias("day"), record.alias("record"))).alias("best")
    return snapshots.groupBy(id_key(F.col(c.entity_id).cast("string")).alias("entity_id")).agg(best).select("entity_id", "best.record.*")


def identity_at_snapshot(snapshot: str, fallback_name: Column, *, columns: fv.Columns = fv.Columns(), available: list[str]) -> Column:
    """Name, display name, class and birth date as the chosen snapshot states them."""
    c = columns
    field = lambda name: F.col(f"{snapshot}.{name}").cast("string") if name in available else F.lit(None).cast("string")
    name = F.coalesce(blank_to_null(field(c.entity_name)), fallback_name)
    return F.struct(
        name.alias("entity_name"),
        F.coalesce(blank_to_null(field(c.display_name)), name).alias("display_name"),
        blank_to_null(field(c.last_class)).alias("context_class"),
        iso_date(field(c.dob)).alias("dob"),
    )


def resolve_simple(
    queries: DataFrame,
    snapshots: DataFrame,
    *,
    query: str = "query",
    aliases: DataFrame | None = None,
    entity_id: str = "fighter_id",
    name: str = "fighter_name",
    display_name: str | None = "display_name",
    ascii_only: bool = False,
) -> DataFrame:
    """Second resolver: exact id, then one alias hop, then name or display name.

    Keys keep punctuation. The alias table has columns alias and destination; a
    destination may be an id or another name.
    """
    ids = snapshots.select(F.col(entity_id).cast("string").alias("entity_id")).distinct()
    labels = F.array(*[F.col(n).cast("string") for n in (name, display_name) if n and n in snapshots.columns])
    index = (
        snapshots.select(F.col(entity_id).cast("string").alias("entity_id"), F.explode(labels).alias("label"))
        .where(~is_blank("label"))
        .distinct()
        .select(simple_name_key("label", ascii_only=ascii_only).alias("name_key"), "entity_id")
        .distinct()
    )
    asked = queries.select(F.col(query).alias("query")).distinct().withColumn("exact", strip("query"))
    asked = asked.withColumn("alias_key", simple_name_key("exact", ascii_only=ascii_only))
    if aliases is not None:
        # a repeated alias keeps one destination
        hop = aliases.groupBy(simple_name_key("alias", ascii_only=ascii_only).alias("alias_key")).agg(F.max("destination").alias("destination"))
        asked = asked.join(hop, "alias_key", "left")
    else:
        asked = asked.withColumn("destination", F.lit(None).cast("string"))
    asked = asked.withColumn("name_key", F.coalesce(simple_name_key("destination", ascii_only=ascii_only), F.col("alias_key")))
    found = (
        asked.join(ids.select(F.col("entity_id").alias("exact"), F.lit(True).alias("is_id")), "exact", "left")
        .join(ids.select(F.col("entity_id").alias("destination"), F.lit(True).alias("is_destination")), "destination", "left")
        .join(_key_summary(index), "name_key", "left")
    )
    direct = F.when(F.col("is_id"), F.col("exact")).when(F.col("is_destination"), F.col("destination"))
    count = F.coalesce("key_entities", F.lit(0))
    return found.select(
        "query",
        F.coalesce(direct, F.when(count == 1, F.col("key_entity"))).alias("entity_id"),
        F.when(F.length("exact") == 0, F.lit("invalid_query"))
        .when(direct.isNotNull(), F.lit(None))
        .when(count == 0, F.lit("not_found"))
        .when(count > 1, F.lit("ambiguous"))
        .alias("error_code"),
    )


def same_entity(a: Column | str, b: Column | str) -> Column:
    """True when both sides are the same known entity."""
    left = F.col(a) if isinstance(a, str) else a
    right = F.col(b) if isinstance(b, str) else b
    return F.coalesce(left.cast("string") == right.cast("string"), F.lit(False))
