"""Score any number of matchup requests in one DataFrame plan.

Work that depends only on an entity and a date (name resolution, the strict as-of
join, refreshed fields) runs once per distinct (query, id, date), then joins back to
the requests, salted where one such key is very common. Everything after that is
row-local: class resolution, both orientations, scoring, range checks and grading.
A bad request gets an error code and never stops the job; the code kept is the first
one in stage order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.skew import hot_key_hashes, salted_lookup, scattered
from duelframe.functions.text import blank_to_null, filled, id_key, name_key, quoted, sql_array, strip
from duelframe.functions.values import clip, is_finite, iso_date
from duelframe.operators.suggest import suggestions
from duelframe.operators import asof, identity, serving
from duelframe.operators.confidence import SupportPolicy, with_support_grade
from duelframe.operators.context_class import class_state_error, inferred_class, snapshot_class, uses_class_state, with_class
from duelframe.operators.pairing import Side, feature_error, history_error, ordered_distinct, out_of_range, with_feature_rows
from duelframe.session import shuffle_width

ALL_CLASSES = tuple(code for code, _, _, _ in fv.CONTEXT_CLASSES)
#: names of a long list that are made one text before the whole list is
_NAMES_A_SLICE = 1000


@dataclass(frozen=True)
class ScoringPlan:
    """What a scoring run needs besides the two tables."""

    features: Sequence[str]
    scorer: object
    calibrate: object = None
    feature_calibrator: object = None
    cutoff: str | None = None
    allow_post_cutoff: bool = True
    supported: Sequence[str] = ALL_CLASSES
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    policy: SupportPolicy = SupportPolicy()
    default_layoff_days: int = fv.DEFAULT_LAYOFF_DAYS
    strict_rating: bool = True
    columns: fv.Columns = fv.Columns()
    #: names, class labels and stances are known to be ASCII, so no text is folded in Python
    ascii_names: bool = False
    balance: bool = True

    def __post_init__(self) -> None:
        if not self.features:
            raise ValueError("features cannot be empty")
        if len(set(self.features)) != len(self.features):
            raise ValueError("features must be unique")


_OPTIONAL = {
    "id_a": "string", "id_b": "string", "division": "string", "division_lbs": "double", "is_womens": "boolean",
    "is_catch_weight": "boolean", "extra": "map<string,double>",
}


def _complete(requests: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(kind) for n, kind in _OPTIONAL.items() if n not in requests.columns}
    return requests.withColumns(missing) if missing else requests


def _side_key(query: Column, explicit: Column, day: Column) -> Column:
    return F.concat_ws("\u0001", query, F.coalesce(explicit.cast("string"), F.lit("\u0002")), day.cast("string"))


def entity_states(sides: DataFrame, snapshots: DataFrame, plan: ScoringPlan, aliases: DataFrame | None = None) -> DataFrame:
    """Per distinct (query, id, date): the entity, its snapshot and refreshed fields."""
    c = plan.columns
    ids = identity.entity_ids(snapshots, c.entity_id)
    index = identity.search_index(
        snapshots, entity_id=c.entity_id, name=c.entity_name, display_name=c.display_name, ascii_only=plan.ascii_names
    )
    if aliases is not None:
        index = identity.add_aliases(index, aliases, ids, ascii_only=plan.ascii_names)
    resolved = identity.resolve(sides, index, ids, explicit_id="explicit_id", ascii_only=plan.ascii_names)
    return side_states(sides, resolved, snapshots.withColumn("__entity", id_key(F.col(c.entity_id).cast("string"))), plan)


def side_states(sides: DataFrame, resolved: DataFrame, keyed: DataFrame, plan: ScoringPlan) -> DataFrame:
    """States of resolved (query, id) pairs on their dates; `keyed` has snapshot rows with their stable id in `__entity`."""
    c = plan.columns
    matched = sides.alias("s").join(
        resolved.alias("r"),
        (F.col("s.query") == F.col("r.query")) & F.col("s.explicit_id").eqNullSafe(F.col("r.explicit_id")),
        "left",
    ).select("s.side_key", "s.query", "s.ref_date", "r.entity_id", F.col("r.error_code").alias("resolve_error"))
    joined = asof.strict_asof(matched, keyed, snapshot_id="__entity", as_of=c.as_of, repeats="repeated")

    fields = keyed.columns
    text = lambda name: F.col(f"snapshot.`{name}`").cast("string") if name in fields else F.lit(None).cast("string")
    number = lambda name: F.col(f"snapshot.`{name}`").cast("double") if name in fields else F.lit(None).cast("double")
    fresh = asof.refreshed_values(
        F.col("ref_date"),
        dob=iso_date(text(c.dob)),
        last_event=iso_date(text(c.last_event)),
        stored_age=number("feature_age_years"),
        activity={n: number(n) for n, _ in fv.ACTIVITY_WINDOWS if n in fields},
        default_layoff_days=plan.default_layoff_days,
    )
    stored = [n for n in fields if n.startswith(c.feature_prefix) and n not in fresh]
    who = identity.identity_at_snapshot("snapshot", strip("query"), columns=c, available=fields)
    as_of = F.col(f"snapshot.`{c.as_of}`").cast("date")
    state = F.struct(
        F.col("entity_id").alias("entity_id"),
        "resolve_error",
        F.when(F.col("snapshot_status") != asof.OK, F.col("snapshot_status")).alias("snapshot_error"),
        "available_first",
        "available_last",
        "repeated",
        as_of.alias("as_of"),
        F.datediff("ref_date", as_of).alias("snapshot_age"),
        who.alias("who"),
        blank_to_null(text(c.last_class)).alias("last_class"),
        snapshot_class(text(c.last_class), ascii_only=plan.ascii_names).alias("class_state"),
        text(c.stance).alias("stance"),
        *[value.alias(name) for name, value in fresh.items()],
        *[number(n).alias(n) for n in stored],
    )
    return joined.select("side_key", state.alias("state"))


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Requests with trimmed texts, all optional columns, the reference date and side keys."""
    base = serving.clean_requests(_complete(requests)).withColumn("ref_date", F.col("predicted_at").cast("date"))
    return base.withColumns(
        {f"__key_{s}": _side_key(F.col(f"query_{s}"), F.col(f"id_{s}"), F.col("ref_date")) for s in ("a", "b")}
    )


def request_sides(base: DataFrame) -> DataFrame:
    """Distinct (query, id, date) of both sides."""
    pair = F.array(
        *[
            F.struct(F.col(f"__key_{s}").alias("side_key"), F.col(f"query_{s}").alias("query"), F.col(f"id_{s}").cast("string").alias("explicit_id"))
            for s in ("a", "b")
        ]
    )
    return base.where("request_error IS NULL").select(F.explode(pair).alias("p"), "ref_date").select("p.*", "ref_date").distinct()


def score_requests(
    requests: DataFrame,
    snapshots: DataFrame | None,
    plan: ScoringPlan,
    *,
    aliases: DataFrame | None = None,
    request_id: str = "request_id",
    states: DataFrame | None = None,
) -> DataFrame:
    """One row per request: prediction fields, or `error_code` when it was rejected.

    `requests` has request_id, query_a, query_b, predicted_at and the optional
    columns id_a, id_b, division, division_lbs, is_womens, is_catch_weight, extra.
    The reference date is the calendar date of predicted_at in the session zone.

    Both sides read the same `entity_states` table. Pass it in when it is persisted
    or written (see `persisted_states`), without `snapshots`; otherwise it is part of this plan.
    """
    names = list(plan.features)
    base = prepare_requests(requests)
    if states is None:
        states = entity_states(request_sides(base), snapshots, plan, aliases)
    joined = base
    for letter in ("a", "b"):
        key = f"__key_{letter}"
        lookup = states.select(F.col("side_key").alias(key), F.col("state").alias(letter))
        # hot keys are looked for in the plain requests, never behind a join
        hot = hot_key_hashes(base, [key]) if plan.balance else []
        joined = salted_lookup(joined, lookup, [key], spread_by=[request_id], hot=hot)
    fields = [f.name for f in states.schema["state"].dataType.fields]
    a, b = Side("a", fields), Side("b", fields)
    resolved = joined.withColumn(
        "__label", F.coalesce(F.col("division"), inferred_class(F.col("a.last_class"), F.col("b.last_class")))
    )
    resolved = with_class(resolved, label="__label", ascii_only=plan.ascii_names)
    rows = with_feature_rows(resolved, names, fields, ascii_only=plan.ascii_names).withColumns({"prior_a": F.expr(a.history()), "prior_b": F.expr(b.history())})
    guard = F.lit(None).cast("string")
    if uses_class_state(names):
        guard = F.coalesce(
            class_state_error(F.col("prior_a"), F.col("a.class_state"), F.col("class_code")),
            class_state_error(F.col("prior_b"), F.col("b.class_state"), F.col("class_code")),
        )
    needs_rating = plan.strict_rating or "feature_mean_elo_global" in names
    coded = rows.withColumn(
        "error_code",
        F.coalesce(
            F.col("request_error"),
            asof.post_cutoff_error(F.col("ref_date"), plan.cutoff, plan.allow_post_cutoff),
            F.col("a.resolve_error"),
            F.col("b.resolve_error"),
            F.when(identity.same_entity("a.entity_id", "b.entity_id"), F.lit("same_entity")),
            F.col("a.snapshot_error"),
            F.col("b.snapshot_error"),
            F.col("a.refresh_error"),
            F.col("b.refresh_error"),
            F.col("class_error"),
            guard,
            history_error(a, b, needs_rating=needs_rating),
            feature_error(names),
        ),
    )
    scored = plan.scorer.add_probability(coded, "x_ab", names, "raw_ab")
    scored = plan.scorer.add_probability(scored, "x_ba", names, "raw_ba")
    if plan.feature_calibrator is not None:
        scored = plan.feature_calibrator.add_probability(scored, "x_ab", names, "cal_ab")
        scored = plan.feature_calibrator.add_probability(scored, "x_ba", names, "cal_ba")
    else:
        calibrate = plan.calibrate or (lambda p: p)
        scored = scored.withColumns({"cal_ab": calibrate(F.col("raw_ab")), "cal_ba": calibrate(F.col("raw_ba"))})
    valid = lambda name: is_finite(F.col(name)) & F.col(name).between(0.0, 1.0)
    model_error = F.when(
        ~(valid("raw_ab") & valid("raw_ba") & valid("cal_ab") & valid("cal_ba")), F.lit("invalid_model_output")
    )
    scored = scored.withColumn("error_code", F.coalesce("error_code", model_error))
    return _predictions(scored, plan, names, request_id)


def persisted_states(requests: DataFrame, snapshots: DataFrame, plan: ScoringPlan, *, aliases: DataFrame | None = None) -> DataFrame:
    """Entity states of a set of requests, kept in memory and on disk until unpersisted."""
    return entity_states(request_sides(prepare_requests(requests)), snapshots, plan, aliases).persist()


def symmetric_probability(cal_ab: Column, cal_ba: Column) -> tuple[Column, Column]:
    """Mean of both orientations clipped to [0, 1], and their absolute gap."""
    other = 1.0 - cal_ba
    return clip((cal_ab + other) / 2.0, 0.0, 1.0), F.abs(cal_ab - other)


def _predictions(scored: DataFrame, plan: ScoringPlan, names: list[str], request_id: str) -> DataFrame:
    ok = F.col("error_code").isNull()
    probability, gap = symmetric_probability(F.col("cal_ab"), F.col("cal_ba"))
    code = F.col("class_code")
    unsupported_class = ~F.col("class_supported") | ~code.isin(*plan.supported)
    reasons = [F.when(unsupported_class, F.concat(F.lit("division '"), code, F.lit("' was not declared supported by the model")))]
    if plan.cutoff is None:
        reasons.append(F.lit("model cutoff metadata is unavailable"))
    measured = scored.withColumns(
        {
            "probability_a": F.when(ok, probability),
            "orientation_disagreement": F.when(ok, gap),
            "days_after_cutoff": asof.days_after_cutoff(F.col("ref_date"), plan.cutoff),
            "outside": out_of_range(names, plan.ranges),
            "reasons": ordered_distinct(reasons),
        }
    )
    graded = with_support_grade(measured, policy=plan.policy)
    graded = graded.withColumns({n: F.when(ok, F.col(n)) for n in ("confidence_score", "confidence_tier", "warnings")})
    p = F.col("probability_a")
    # the side that the first error came from
    state_error = class_state_error(F.col("prior_a"), F.col("a.class_state"), F.col("class_code"))
    on_a = (
        F.when(F.col("a.resolve_error").isNotNull(), F.lit(True))
        .when(F.col("b.resolve_error").isNotNull(), F.lit(False))
        .when(F.col("a.snapshot_error").isNotNull(), F.lit(True))
        .when(F.col("b.snapshot_error").isNotNull(), F.lit(False))
        .otherwise(state_error.isNotNull())
    )
    side = lambda name: F.when(on_a, F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))
    on_snapshot = F.col("error_code").isin("snapshot_unavailable", "duplicate_snapshot")
    orientation = lambda first, second, raw, cal: F.when(
        ok,
        F.struct(
            F.col(f"{first}.entity_id").alias("first_id"), F.col(f"{second}.entity_id").alias("second_id"),
            F.col(raw).alias("raw_probability_first"), F.col(cal).alias("calibrated_probability_first"),
        ),
    )
    entity = lambda s: F.when(
        ok,
        F.struct(
            F.col(f"{s}.entity_id").alias("entity_id"), F.col(f"{s}.who.entity_name").alias("entity_name"),
            F.col(f"{s}.who.display_name").alias("display_name"), F.col(f"{s}.who.context_class").alias("context_class"),
            F.col(f"{s}.who.dob").alias("dob"), F.col(f"{s}.as_of").alias("as_of"),
        ),
    )
    cutoff = F.lit(plan.cutoff).cast("date")
    return graded.select(
        request_id,
        "error_code",
        entity("a").alias("entity_a"),
        entity("b").alias("entity_b"),
        "predicted_at",
        "ref_date",
        cutoff.alias("model_cutoff"),
        cutoff.alias("dataset_cutoff"),
        F.when(ok, code).alias("division"),
        "probability_a",
        (1.0 - p).alias("probability_b"),
        F.when(ok, F.col("prior_a").cast("bigint")).alias("prior_ufc_fights_a"),
        F.when(ok, F.col("prior_b").cast("bigint")).alias("prior_ufc_fights_b"),
        F.when(ok, F.col("a.as_of")).alias("snapshot_date_a"),
        F.when(ok, F.col("b.as_of")).alias("snapshot_date_b"),
        serving.winner(p, F.col("a.entity_id"), F.col("b.entity_id")).alias("predicted_winner_id"),
        serving.winner(p, F.col("a.who.display_name"), F.col("b.who.display_name")).alias("predicted_winner_name"),
        serving.is_even(p).alias("is_even_probability"),
        orientation("a", "b", "raw_ab", "cal_ab").alias("orientation_a_vs_b"),
        orientation("b", "a", "raw_ba", "cal_ba").alias("orientation_b_vs_a"),
        "orientation_disagreement",
        "days_after_cutoff",
        "confidence_tier",
        "confidence_score",
        "warnings",
        F.when(ok, F.map_from_arrays(F.expr(sql_array(names)), F.col("x_ab"))).alias("features_a_vs_b"),
        F.when(ok, F.map_from_arrays(F.expr(sql_array(names)), F.col("x_ba"))).alias("features_b_vs_a"),
        "query_a",
        "query_b",
        F.when(on_snapshot, side("entity_id")).alias("failed_entity_id"),
        F.when(on_snapshot, side("available_first")).alias("available_first"),
        F.when(on_snapshot, side("available_last")).alias("available_last"),
        F.when(~ok, F.when(on_a, F.col("query_a")).otherwise(F.col("query_b"))).alias("failed_query"),
        F.when(~ok, F.when(on_a, F.col("id_a")).otherwise(F.col("id_b")).cast("string")).alias("failed_id"),
        F.when(~ok, F.when(on_a, F.lit(fv.SIDE_NAMES[0])).otherwise(F.lit(fv.SIDE_NAMES[1]))).alias("failed_side"),
        F.when(~ok, side("class_state")).alias("failed_state"),
        F.when(~ok, F.col("__label")).alias("failed_label"),
        F.when(~ok, code).alias("failed_class"),
        F.when(on_snapshot, side("repeated")).alias("failed_repeats"),
    )


FAILURE_FIELDS = (
    "failed_entity_id", "available_first", "available_last", "failed_query", "failed_id", "failed_side", "failed_state", "failed_label", "failed_class",
    "failed_repeats",
)


def split_outcomes(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions and rejected requests. Persist or write `scored` before using both.

    The rows pass through a generator first. A filter on the computed error code
    would otherwise be pushed down as a copy of the whole computation.
    """
    sealed = scored.select(F.inline(F.array(F.struct("*"))))
    key = scored.columns[0]
    return (
        sealed.where("error_code IS NULL").drop("error_code", *FAILURE_FIELDS),
        sealed.where("error_code IS NOT NULL").select(key, "error_code", "query_a", "query_b", "ref_date", *FAILURE_FIELDS),
    )


def _detail() -> Column:
    """What is wrong with one request, in the words of the contract; null where nothing may be said."""
    code, named = F.col("error_code"), F.coalesce("failed_id", "failed_query")
    missing = filled(fv.MSG_NO_MATCH, quoted(named))
    close = F.when(F.col("failed_id").isNull() & (F.length("close") > 0), filled(fv.MSG_CLOSE, F.col("close"))).otherwise(F.lit(""))
    return (
        F.when(code == "not_found", F.concat(missing, close))
        .when(code == "identity_mismatch", filled(fv.MSG_OTHER_ID, quoted(F.col("failed_query")), quoted(id_key("failed_id"))))
        .when(code == "duplicate_snapshot", filled(fv.MSG_REPEATED, F.col("failed_entity_id"), F.col("failed_repeats.n"), F.col("failed_repeats.day")))
        .when(code == "post_cutoff_disabled", F.lit(fv.MSG_POST_CUTOFF))
        .when(code == "class_unsupported", filled(fv.MSG_CLASS_UNSUPPORTED, quoted(F.col("failed_label"))))
        .when(code == "class_required", F.lit(fv.MSG_CLASS_REQUIRED))
        .when(code == "class_weight_required", F.lit(fv.MSG_CLASS_WEIGHT))
        .when(code == "class_state_missing", filled(fv.MSG_STATE_MISSING, F.col("failed_side")))
        .when(code == "class_state_mismatch", filled(fv.MSG_STATE_MISMATCH, F.col("failed_side"), F.col("failed_state"), F.col("failed_class")))
    )


def _text_list(order: str, text: str) -> Column:
    """Texts of a group in order; only for groups that a task can hold as rows."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), ", ")


def _long_lists(matches: DataFrame) -> DataFrame:
    """Display names of every `__key` as one `__list`, by entity id; `__fewest` is their number below zero.

    A common name has any number of entities, and rows that are being collected stay in memory, where nothing spills
    them. So names are numbered by a sort and made one text a thousand; what is collected of a key are these texts.
    """
    order = Window.partitionBy("__key").orderBy("entity_id", "display_name")
    numbered = matches.select("__key", "display_name", (F.row_number().over(order) - 1).cast("bigint").alias("__place"))
    sliced = numbered.withColumn("__slice", F.floor(F.col("__place") / _NAMES_A_SLICE))
    slices = sliced.groupBy("__key", "__slice").agg(_text_list("__place", "display_name").alias("__names"), F.count(F.lit(1)).alias("__size"))
    return slices.groupBy("__key").agg(_text_list("__slice", "__names").alias("__list"), (-F.sum("__size")).alias("__fewest"))


def rejection_table(
    rejected: DataFrame,
    snapshots: DataFrame | None,
    *,
    columns: fv.Columns = fv.Columns(),
    aliases: DataFrame | None = None,
    ascii_names: bool = False,
    names: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Rejected requests with a message that is safe to show.

    Ambiguous names list all their matches and unknown ones the closest names; both lists are made once per
    name, not per request. Ids in a message give way to names. `names` and `index` (display names and search keys) are
    taken from the snapshots unless they are given.
    """
    c, key = columns, rejected.columns[0]
    if names is None:
        names = identity.latest_records(snapshots, columns=c).select("entity_id", "display_name")
    if index is None:
        index = identity.search_index(snapshots, entity_id=c.entity_id, name=c.entity_name, display_name=c.display_name, ascii_only=ascii_names)
        if aliases is not None:
            index = identity.add_aliases(index, aliases, identity.entity_ids(snapshots, c.entity_id), ascii_only=ascii_names)
    by_name = F.col("error_code").isin("ambiguous", "not_found") & F.col("failed_id").isNull()
    keyed = rejected.withColumn("__key", F.when(by_name, name_key("failed_query", ascii_only=ascii_names)))
    asked = keyed.where("__key IS NOT NULL").select("error_code", F.col("__key").alias("name_key")).distinct()
    several = asked.where("error_code = 'ambiguous'").join(index, "name_key").select(F.col("name_key").alias("__key"), "entity_id")
    near = suggestions(asked.where("error_code = 'not_found'").select("name_key"), index).select(F.col("query_key").alias("__key"), "entity_id", "suggestion_rank")
    close = near.join(names, "entity_id").groupBy("__key").agg(_text_list("suggestion_rank", "display_name").alias("close"))
    # a missing name is left out here, as the text of a slice without names would leave a comma
    matches = several.join(names, "entity_id").where("display_name IS NOT NULL")
    # most rejections name neither a list nor an entity; their nulls are spread over all tasks
    keyed = keyed.withColumn("__key", scattered(F.col("__key"), F.col(key)))
    ambiguous = F.col("error_code").eqNullSafe("ambiguous")
    spread = keyed.where(~ambiguous).withColumns({"__failed": scattered(F.col("failed_entity_id"), F.col(key))})
    joined = spread.join(close, "__key", "left").join(
        names.select(F.col("entity_id").alias("__failed"), F.col("display_name").alias("failed_name")), "__failed", "left"
    )
    message = serving.rejection_message(
        "error_code", entity=F.col("failed_name"), reference=F.col("ref_date"), first=F.col("available_first"),
        last=F.col("available_last"), candidates=F.lit(None).cast("string"), detail=_detail(),
    )
    said = joined.withColumn("__message", message)
    # ids stand only in messages that quote a request or name an entity
    quotes = said.where(F.col("error_code").isin(*serving.LOOKUP_CODES, *serving.UNSUPPORTED_CODES)).select(key, "__message").distinct()
    safe = serving.redact_ids(quotes, names, key=key, message="__message").select(key, "safe_message").distinct()
    unlisted = said.join(safe, key, "left").withColumn("error_message", F.coalesce("safe_message", "__message"))
    # A common name has any number of matches. Their list is joined last, in tasks that make no other messages, longest lists first:
    # a writer that sizes its pages by the rows before would take in thousands of long rows behind short ones. The width is stated,
    # as a few bytes a request become long texts.
    counts = matches.groupBy("__key").agg((-F.count(F.lit(1))).alias("__fewest"))
    asking = keyed.where(ambiguous).join(counts, "__key", "left").withColumn("__fewest", F.coalesce("__fewest", F.lit(0)))
    asking = asking.repartition(shuffle_width(rejected.sparkSession), "__fewest", "__key")
    # the whole message of a name is made once
    lists = _long_lists(matches).select("__fewest", "__key", F.lit("ambiguous").alias("error_code"), serving.ambiguous_message(F.col("__list")).alias("__listed"))
    listed = asking.join(lists, ["__fewest", "__key", "error_code"], "left").withColumn("error_message", F.coalesce("__listed", F.lit(fv.MSG_AMBIGUOUS)))
    shown = (key, "error_code", "query_a", "query_b", "ref_date", "available_first", "available_last", "error_message")
    return listed.select(*shown).unionByName(unlisted.select(*shown))
