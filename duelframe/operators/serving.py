"""Public projection, redaction, request hygiene and failure routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import blank_to_null, col, strip

# fixed values: error codes whose message may be shown as it is
UNAVAILABLE_CODES = ("snapshot_unavailable",)
LOOKUP_CODES = ("not_found", "identity_mismatch", "duplicate_snapshot", "invalid_query")
UNSUPPORTED_CODES = (
    "post_cutoff_disabled", "class_required", "class_unsupported", "class_weight_required",
    "class_state_missing", "class_state_mismatch",
)


def hygiene_error(query_a: Column | str, query_b: Column | str, context_class: Column | str) -> Column:
    """Code for a request whose texts are empty or too long."""
    a, b, label = strip(query_a), strip(query_b), strip(context_class)
    bad_name = lambda t: ~F.coalesce(F.length(t).between(1, 160), F.lit(False))
    return (
        F.when(bad_name(a), F.lit("invalid_query"))
        .when(bad_name(b), F.lit("invalid_query"))
        .when(F.length(label) > 80, F.lit("invalid_class"))
    )


def clean_requests(
    requests: DataFrame, *, query_a: str = "query_a", query_b: str = "query_b", context_class: str = "division"
) -> DataFrame:
    """Trimmed texts, blank class as null, and `request_error`."""
    trimmed = requests.withColumns(
        {query_a: strip(query_a), query_b: strip(query_b), context_class: blank_to_null(context_class)}
    )
    return trimmed.withColumn("request_error", hygiene_error(query_a, query_b, context_class))


def winner(probability: Column, name_a: Column, name_b: Column) -> Column:
    even = F.abs(probability - 0.5) <= fv.EVEN_TOLERANCE
    return F.when(even, F.lit(None)).when(probability > 0.5, name_a).when(probability < 0.5, name_b)


def is_even(probability: Column) -> Column:
    return F.abs(probability - 0.5) <= fv.EVEN_TOLERANCE


def public_entity(entity_name: Column, display_name: Column) -> Column:
    """Names only; stable ids stay behind."""
    name = blank_to_null(entity_name)
    shown = F.coalesce(blank_to_null(display_name), name)
    safe = F.coalesce(name, shown, F.lit(fv.UNKNOWN_ENTITY_NAME))
    return F.struct(safe.alias("fighter_name"), F.coalesce(shown, safe).alias("display_name"))


def public_warnings(warnings: Column) -> Column:
    """Code, severity and message of complete warnings, details left out."""
    complete = lambda w: (F.length(strip(w["code"])) > 0) & (F.length(strip(w["severity"])) > 0) & (F.length(strip(w["message"])) > 0)
    kept = F.filter(F.coalesce(warnings, F.array().cast("array<struct<code:string,severity:string,message:string,details:map<string,string>>>")), complete)
    return F.transform(
        kept,
        lambda w: F.struct(strip(w["code"]).alias("code"), strip(w["severity"]).alias("severity"), strip(w["message"]).alias("message")),
    )


def public_predictions(predictions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Serving table: allowed fields, names without ids, warnings without details."""
    shown = public_warnings(F.col("warnings"))
    return predictions.select(
        *(keep or []),
        *[c for c in fv.PUBLIC_FIELDS if c in predictions.columns],
        public_entity(F.col("entity_a.entity_name"), F.col("entity_a.display_name")).alias("fighter_a"),
        public_entity(F.col("entity_b.entity_name"), F.col("entity_b.display_name")).alias("fighter_b"),
        shown.alias("warnings"),
        F.struct(
            F.coalesce(F.col("confidence_tier"), F.lit("reduced")).alias("tier"),
            F.col("confidence_score").alias("score"),
            F.col("orientation_disagreement").alias("orientation_disagreement"),
            shown.alias("warnings"),
        ).alias("confidence"),
    )


def redact_ids(
    messages: DataFrame, names: DataFrame, *, key: str, message: str, out: str = "safe_message", own_names: bool = False
) -> DataFrame:
    """Replace id-like tokens by display names; unknown ids get a fixed text.

    Tokens are pulled out, made distinct and joined to the name table; the pieces
    between them are kept in order, so nothing else in the text changes. An id that has
    several names gets the first one in text order that is not blank. With `own_names`, the name table has the key
    too, and a name counts only for the message of its key.
    """
    pattern = fv.REDACTED_ID_PATTERN
    found = F.regexp_extract_all(F.col(message), F.lit(f"({pattern})"), F.lit(1))
    base = messages.select(key, message).distinct()
    # a token is a key of the message's map, so neither repeated keys nor repeated ids may double it
    tokens = base.select(key, F.explode(F.array_distinct(found)).alias("token")).distinct()
    on = [key, "entity_id"] if own_names else ["entity_id"]
    ids = names.groupBy(*on).agg(F.min(blank_to_null("display_name")).alias("display_name"))
    named = (
        tokens.withColumn("entity_id", F.when(F.length("token") == 16, F.lower("token")).otherwise(F.col("token")))
        .join(ids, on, "left")
        .select(key, F.struct("token", F.coalesce("display_name", F.lit(fv.UNKNOWN_ENTITY_NAME)).alias("name")).alias("pair"))
    )
    # one message holds a handful of tokens, so the list per message is short
    per_message = named.groupBy(key).agg(F.map_from_entries(F.collect_list("pair")).alias("__names"))
    joined = messages.join(per_message, key, "left")
    gaps = F.split(F.regexp_replace(F.col(message), pattern, "\u0001"), "\u0001")
    pieces = F.zip_with(
        gaps, found,
        lambda gap, token: F.concat(gap, F.when(token.isNull(), F.lit("")).otherwise(F.try_element_at(F.col("__names"), token))),
    )
    text = F.when(F.col("__names").isNull(), F.col(message)).otherwise(F.array_join(pieces, ""))
    return joined.withColumn(out, text).drop("__names")


def ambiguous_message(candidates: Column) -> Column:
    """The text for an ambiguous name, with the list of its matches where there is one."""
    return F.when(F.length(candidates) > 0, F.concat(F.lit(f"{fv.MSG_AMBIGUOUS} Matches: "), candidates, F.lit("."))).otherwise(F.lit(fv.MSG_AMBIGUOUS))


def rejection_message(
    code: Column | str,
    *,
    entity: Column,
    reference: Column,
    first: Column,
    last: Column,
    candidates: Column,
    detail: Column,
) -> Column:
    """Safe text for a rejected request."""
    c = col(code)
    dates = F.when(
        first.isNotNull(),
        F.concat(F.lit(" Available snapshot dates run from "), first.cast("string"), F.lit(" through "), last.cast("string"), F.lit(".")),
    ).otherwise(F.lit(" No usable snapshot is available for this fighter."))
    unavailable = F.concat(
        F.coalesce(entity, F.lit(fv.UNKNOWN_ENTITY_NAME)), F.lit(" has no snapshot available before the current server date ("),
        reference.cast("string"), F.lit(")."), dates,
    )
    return (
        F.when(c.isin(*UNAVAILABLE_CODES), unavailable)
        .when(c == "ambiguous", ambiguous_message(candidates))
        .when(c == "same_entity", F.lit(fv.MSG_SAME))
        .when(c.isin(*LOOKUP_CODES, *UNSUPPORTED_CODES), F.coalesce(detail, F.lit(fv.MSG_GENERIC)))
        .otherwise(F.lit(fv.MSG_GENERIC))
    )


def availability(snapshots: DataFrame, *, run_id: str, cutoff: str, as_of: str = "as_of_date") -> DataFrame:
    """One row of serving state: run, cutoff and snapshot date range."""
    return snapshots.agg(F.min(as_of).cast("date").alias("snapshot_start_date"), F.max(as_of).cast("date").alias("snapshot_end_date")).select(
        F.lit("ok").alias("status"),
        F.lit(run_id).alias("artifact_version"),
        F.lit(cutoff).cast("date").alias("dataset_cutoff"),
        "snapshot_start_date",
        "snapshot_end_date",
    )
