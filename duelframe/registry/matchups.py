"""Point-in-time joins, pair features and scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.values import bad_number, count_value, number_or, sigmoid
from duelframe.operators import asof, pairing, serving
from duelframe.operators.confidence import SupportPolicy, with_support_grade
from duelframe.operators.context_class import (
    class_state_error, inferred_class, known_stance, snapshot_class, supported_classes, with_class,
)
from duelframe.operators.scorers import LinearScorer
from duelframe.plans.score import ScoringPlan, rejection_table, score_requests, split_outcomes, symmetric_probability
from duelframe.registry import fixtures as fx
from duelframe.registry.base import query, r6, rounded, scratch, table
from duelframe.registry.identity import ENTITIES_SQL, entities
from duelframe.streaming.published import publish
from duelframe.streaming.requests import read_requests, score_stream

POINT_SQL = f"{fx.SNAPSHOTS_SQL}, {fx.REQUESTS_SQL}"
JOINED_SQL = """
ranges AS (SELECT entity_id, MIN(as_of) AS lo, MAX(as_of) AS hi FROM snaps GROUP BY 1),
joined AS (SELECT r.request_id, r.a_id, r.ref_date, s.*, lo, hi FROM requests r ASOF LEFT JOIN snaps s ON r.a_id = s.entity_id AND r.ref_date > s.as_of
  LEFT JOIN ranges g ON g.entity_id = r.a_id)
"""


def _joined(spark, sf):
    return asof.strict_asof(fx.requests(spark, sf), fx.snapshots(spark, sf), entity_id="a_id", spread_by=["request_id"])


@query(
    "a01_strict_asof",
    f"WITH {POINT_SQL}, {JOINED_SQL} SELECT request_id, a_id, ref_date, as_of, round(feature_career_minutes, 6) AS minutes FROM joined",
)
def strict_asof(spark, sf):
    out = _joined(spark, sf)
    return out.select("request_id", "a_id", "ref_date", "snapshot.as_of", r6("snapshot.feature_career_minutes").alias("minutes"))


@query(
    "a02_unavailable",
    f"WITH {POINT_SQL}, {JOINED_SQL} SELECT request_id, a_id, 'snapshot_unavailable' AS snapshot_status, lo AS available_first, hi AS available_last FROM joined WHERE as_of IS NULL AND lo IS NOT NULL",
)
def unavailable(spark, sf):
    out = _joined(spark, sf).where(F.col("snapshot_status") == asof.UNAVAILABLE)
    return out.select("request_id", "a_id", "snapshot_status", "available_first", "available_last")


@query(
    "a03_duplicate_snapshots",
    f"""WITH {fx.REQUESTS_SQL}, per_day AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY ALL),
    known AS (SELECT DISTINCT user_id FROM per_day)
    SELECT request_id, CASE WHEN k.user_id IS NULL THEN 'not_found' WHEN n IS NULL THEN 'snapshot_unavailable' WHEN n > 1 THEN 'duplicate_snapshot' ELSE 'ok' END AS snapshot_status
    FROM requests r ASOF LEFT JOIN per_day p ON r.a_id = p.user_id AND r.ref_date > p.day LEFT JOIN known k ON k.user_id = r.a_id""",
)
def duplicates(spark, sf):
    raw = table(spark, sf, "events").where("user_id % 3 <> 0").select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("as_of"), "value")
    out = asof.strict_asof(fx.requests(spark, sf), raw, entity_id="a_id")
    return out.select("request_id", "snapshot_status")


REFRESH_SQL = f"""{POINT_SQL}, {JOINED_SQL},
fresh AS (SELECT request_id, ref_date, dob, last_event, feature_activity_365d, feature_activity_730d,
   date_diff('day', CAST(last_event - CAST(700 * (entity_id % 2) AS INT) AS DATE), ref_date) AS layoff FROM joined WHERE as_of IS NOT NULL)"""


def _fresh(spark, sf):
    s = _joined(spark, sf).where("snapshot.as_of IS NOT NULL")
    last = F.date_sub("snapshot.last_event", (700 * (F.col("snapshot.entity_id") % 2)).cast("int"))
    values = asof.refreshed_values(
        F.col("ref_date"), dob=F.col("snapshot.dob"), last_event=last, stored_age=F.lit(30.5),
        activity={n: F.col(f"snapshot.{n}") for n, _ in fv.ACTIVITY_WINDOWS},
    )
    return s.select("request_id", *[v.alias(k) for k, v in values.items()])


@query(
    "a04_age_refresh",
    f"""WITH {REFRESH_SQL} SELECT request_id, round(CASE WHEN dob IS NULL THEN 30.5 ELSE date_diff('day', dob, ref_date) / 365.2425 END, 6) AS feature_age_years,
    CASE WHEN dob IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS feature_age_missing, CAST(CASE WHEN dob >= ref_date THEN 'birth_not_before_reference' END AS VARCHAR) AS refresh_error FROM fresh""",
)
def age(spark, sf):
    return rounded(_fresh(spark, sf).select("request_id", "feature_age_years", "feature_age_missing", "refresh_error"), "feature_age_years")


@query(
    "a05_layoff_refresh",
    f"WITH {REFRESH_SQL} SELECT request_id, round(ln(1 + coalesce(layoff, 365)), 6) AS feature_log_layoff_days, CAST(layoff AS INT) AS layoff_days FROM fresh",
)
def layoff(spark, sf):
    return rounded(_fresh(spark, sf).select("request_id", "feature_log_layoff_days", "layoff_days"), "feature_log_layoff_days")


@query(
    "a06_activity_refresh",
    f"""WITH {REFRESH_SQL} SELECT request_id, CASE WHEN last_event IS NULL OR layoff > 365 THEN 0 ELSE feature_activity_365d END AS feature_activity_365d,
    CASE WHEN last_event IS NULL OR layoff > 730 THEN 0 ELSE feature_activity_730d END AS feature_activity_730d FROM fresh""",
)
def activity(spark, sf):
    return _fresh(spark, sf).select("request_id", "feature_activity_365d", "feature_activity_730d")


@query(
    "a07_cutoff_gate",
    f"""WITH {fx.REQUESTS_SQL} SELECT request_id, CAST(greatest(0, date_diff('day', DATE '2024-01-10', ref_date)) AS INT) AS days_after_cutoff,
    CASE WHEN ref_date > DATE '2024-01-10' THEN 'post_cutoff_disabled' END AS error_code FROM requests""",
)
def cutoff_gate(spark, sf):
    day = F.col("ref_date")
    return fx.requests(spark, sf).select(
        "request_id", asof.days_after_cutoff(day, "2024-01-10").alias("days_after_cutoff"),
        asof.post_cutoff_error(day, "2024-01-10", False).alias("error_code"),
    )


# --- context class: labels spread over the orders --------------------------------------

LABELS = [
    "UFC Lightweight Title Bout", "m_light", "Women's Flyweight Bout", "CATCH", "catch_weight", "Openweight", "", "UNKNOWN",
    "UFC Interim Heavyweight Title Bout", "W_STRAW", "men's welterweight", "Super Feather",
]
LABELS_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LABELS) + "]"
CLASS_ROWS_SQL = ", ".join(f"('{c}', {p if p is not None else 'NULL'}, {str(w).lower()}, {str(k).lower()})" for c, p, w, k in fv.CONTEXT_CLASSES)
ALIAS_ROWS_SQL = ", ".join(f"('{a}', '{c}')" for a, c in fv.CONTEXT_ALIASES.items())
CLEAN_SQL = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(lower(replace(trim({x}), '_', ' ')), '''', ''), 'ufc ', ' '), ' interim ', ' '), ' title ', ' '),
    ' tournament ', ' '), ' superfight ', ' '), ' bout', ' '), ' +', ' ', 'g'))"""
DIMENSIONS_SQL = f"""
classes(code, pounds, womens, catch) AS (VALUES {CLASS_ROWS_SQL}),
class_aliases(label, code) AS (VALUES {ALIAS_ROWS_SQL})
"""
CONTEXT_SQL = f"""{DIMENSIONS_SQL},
ctx AS (SELECT o_orderkey, nullif(list_element({LABELS_SQL}, CAST(o_orderkey % {len(LABELS)} + 1 AS INT)), '') AS label,
   CASE o_custkey % 5 WHEN 0 THEN 155.0 WHEN 1 THEN 125.0 WHEN 2 THEN 140.5 END AS lbs,
   CASE o_custkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS womens,
   CASE o_custkey % 11 WHEN 0 THEN true WHEN 1 THEN false END AS is_catch FROM orders),
coded AS (SELECT ctx.*, coalesce(c1.code, a.code) AS code FROM ctx LEFT JOIN classes c1 ON upper(trim(label)) = c1.code
   LEFT JOIN class_aliases a ON {CLEAN_SQL.format(x="ctx.label")} = a.label),
full_ctx AS (SELECT coded.*, b.pounds AS bp, b.womens AS bw, b.catch AS bc FROM coded LEFT JOIN classes b ON coded.code = b.code)"""


def _context(spark, sf):
    labels = F.array(*[F.lit(x) for x in LABELS])
    label = F.expr("nullif(x, '')")
    cust = F.col("o_custkey")
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.element_at(labels, (F.col("o_orderkey") % len(LABELS) + 1).cast("int")).alias("x"))
    return base.select(
        "o_orderkey",
        label.alias("label"),
        F.when(cust % 5 == 0, 155.0).when(cust % 5 == 1, 125.0).when(cust % 5 == 2, 140.5).alias("lbs"),
        F.when(cust % 7 == 0, True).when(cust % 7 == 1, False).when(cust % 7 == 2, False).alias("womens"),
        F.when(cust % 11 == 0, True).when(cust % 11 == 1, False).alias("is_catch"),
    )


@query(
    "f02_resolve_class",
    f"""WITH {CONTEXT_SQL}, e AS (SELECT *, code IS NULL AND lbs IS NOT NULL AND womens IS NOT NULL AS custom FROM full_ctx)
    SELECT o_orderkey, CASE WHEN code IS NOT NULL THEN code WHEN label IS NOT NULL THEN trim(label) ELSE 'UNSPECIFIED' END AS code, CAST(coalesce(lbs, bp) AS DOUBLE) AS pounds,
      CASE WHEN code IS NOT NULL THEN bw ELSE womens END AS womens, CASE WHEN code IS NOT NULL THEN bc ELSE coalesce(is_catch, false) END AS catch, code IS NOT NULL AS supported,
      CASE WHEN code IS NULL AND NOT custom AND label IS NOT NULL THEN 'class_unsupported' WHEN code IS NULL AND NOT custom THEN 'class_required' WHEN custom THEN NULL
        WHEN coalesce(lbs, bp) IS NULL THEN 'class_weight_required' WHEN abs(lbs - bp) > 1e-9 THEN 'class_weight_conflict' WHEN womens <> bw THEN 'class_womens_conflict'
        WHEN is_catch <> bc THEN 'class_catch_conflict' END AS error FROM e""",
)
def resolved_class(spark, sf):
    out = with_class(_context(spark, sf), label="label", pounds="lbs", womens="womens", catch="is_catch", prefix="c_")
    return out.select("o_orderkey", *[F.col(f"c_{n}").alias(n) for n in ("code", "pounds", "womens", "catch", "supported", "error")])


@query(
    "f03_snapshot_class",
    f"""WITH {CONTEXT_SQL} SELECT o_orderkey, CASE WHEN upper(trim(label)) NOT IN ('UNKNOWN', 'OPEN') THEN code END AS code FROM full_ctx""",
)
def stored_class(spark, sf):
    return _context(spark, sf).select("o_orderkey", snapshot_class(F.col("label")).alias("code"))


@query(
    "f04_inferred_class",
    f"""WITH t AS (SELECT o_orderkey, list_element({LABELS_SQL}, CAST(o_orderkey % 4 + 6 AS INT)) AS a, list_element({LABELS_SQL}, CAST(o_custkey % 4 + 6 AS INT)) || ' ' AS b FROM orders)
    SELECT o_orderkey, CASE WHEN trim(a) <> '' AND trim(a) = trim(b) AND trim(a) NOT IN ('UNKNOWN', 'OPEN') THEN trim(a) END AS label FROM t""",
)
def inferred(spark, sf):
    labels = F.array(*[F.lit(x) for x in LABELS])
    a = F.element_at(labels, (F.col("o_orderkey") % 4 + 6).cast("int"))
    b = F.concat(F.element_at(labels, (F.col("o_custkey") % 4 + 6).cast("int")), F.lit(" "))
    return table(spark, sf, "orders").select("o_orderkey", inferred_class(a, b).alias("label"))


@query(
    "f05_class_state",
    f"""WITH {CONTEXT_SQL} SELECT f.o_orderkey, CASE WHEN o.o_custkey % 4 - 1 < 0 THEN 'negative_history' WHEN o.o_custkey % 4 - 1 = 0 THEN NULL
      WHEN code IS NULL OR upper(trim(label)) IN ('UNKNOWN', 'OPEN') THEN 'class_state_missing' WHEN code <> 'M_LIGHT' THEN 'class_state_mismatch' END AS error
    FROM full_ctx f JOIN orders o USING (o_orderkey)""",
)
def class_state(spark, sf):
    context = _context(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    error = class_state_error((F.col("o_custkey") % 4 - 1).cast("double"), F.col("stored"), F.lit("M_LIGHT"))
    context = context.withColumn("stored", snapshot_class(F.col("label")))
    return context.select("o_orderkey", error.alias("error"))


@query(
    "f06_known_stance",
    """WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.4 WHEN 2 THEN 0.5 ELSE 0 END AS flag,
      list_element([' Orthodox', 'UNKNOWN', 'nan', '', 'Switch ', NULL], CAST(p_partkey % 6 + 1 AS INT)) AS stance FROM part)
    SELECT p_partkey, CASE WHEN coalesce(flag, 1) < 0.5 AND lower(trim(stance)) NOT IN ('', 'unknown', 'nan', 'none') THEN lower(trim(stance)) END AS stance FROM t""",
)
def stances(spark, sf):
    kind = F.col("p_size") % 5
    flag = F.when(kind == 0, F.lit(None)).when(kind == 1, 0.4).when(kind == 2, 0.5).otherwise(0.0)
    words = F.array(*[F.lit(x) for x in (" Orthodox", "UNKNOWN", "nan", "", "Switch ", None)])
    stance = F.element_at(words, (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", known_stance(flag, stance).alias("stance"))


@query(
    "f10_number_coercion",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL ELSE CAST(o_custkey + 0.5 AS VARCHAR) END AS raw FROM orders)
    SELECT o_orderkey, CASE WHEN raw = 'abc' THEN NULL WHEN raw IS NULL OR raw IN ('', 'NaN') THEN 7.0 ELSE CAST(raw AS DOUBLE) END AS value, coalesce(raw = 'abc', false) AS bad,
      CASE WHEN raw = 'abc' THEN NULL WHEN raw IS NULL OR raw IN ('', 'NaN') THEN 0 ELSE round_even(CAST(raw AS DOUBLE), 0) END AS counted FROM t""",
)
def coercion(spark, sf):
    kind = F.col("o_orderkey") % 6
    raw = F.when(kind == 0, "").when(kind == 1, "abc").when(kind == 2, "NaN").when(kind == 3, F.lit(None)).otherwise((F.col("o_custkey") + 0.5).cast("string"))
    df = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return df.select("o_orderkey", number_or("raw", 7.0).alias("value"), bad_number("raw").alias("bad"), count_value("raw").alias("counted"))


# --- pair features over two snapshots ------------------------------------------------------

PAIR_SQL = f"""{POINT_SQL},
pairs AS (SELECT r.request_id, r.ref_date, a.feature_prior_fights AS pa, b.feature_prior_fights AS pb, a.feature_career_minutes AS ma, b.feature_career_minutes AS mb,
    a.feature_errors AS ea, b.feature_errors AS eb
  FROM (SELECT r.*, s.as_of AS as_a FROM requests r ASOF LEFT JOIN snaps s ON r.a_id = s.entity_id AND r.ref_date > s.as_of) r
  JOIN snaps a ON a.entity_id = r.a_id AND a.as_of = r.as_a
  ASOF JOIN snaps b ON r.b_id = b.entity_id AND r.ref_date > b.as_of)"""


def _pairs(spark, sf):
    snaps = fx.snapshots(spark, sf)
    first = asof.strict_asof(fx.requests(spark, sf), snaps, entity_id="a_id", out="a").drop("snapshot_status", "available_first", "available_last")
    both = asof.strict_asof(first, snaps, entity_id="b_id", out="b")
    return both.where("a IS NOT NULL AND b IS NOT NULL"), snaps.columns


@query(
    "f07_difference_features",
    f"WITH {PAIR_SQL} SELECT request_id, pa - pb AS prior, round(ma - mb, 6) AS minutes, ea - eb AS errors FROM pairs",
)
def differences(spark, sf):
    df, fields = _pairs(spark, sf)
    a, b = pairing.Side("a", fields), pairing.Side("b", fields)
    d = lambda name: F.expr(pairing.difference_sql(a, b, fv.DIFFERENCE_PREFIX + name))
    return df.select("request_id", d("prior_fights").alias("prior"), r6(d("career_minutes")).alias("minutes"), d("errors").alias("errors"))


def _rows(spark, sf, names, catch=False, extra=None):
    """Both feature rows of every pair."""
    df, fields = _pairs(spark, sf)
    df = df.withColumns({"class_pounds": F.lit(155.0), "class_womens": F.lit(False), "class_catch": F.lit(catch)})
    if extra is not None:
        df = df.withColumn("extra", extra)
    return pairing.with_feature_rows(df, names, fields, extra="extra" if extra is not None else None)


@query(
    "f08_shared_features",
    f"""WITH {PAIR_SQL} SELECT request_id, CAST(155 AS DOUBLE) AS feature_division_lbs, CAST(0 AS DOUBLE) AS feature_is_womens, CAST(1 AS DOUBLE) AS feature_is_catch_weight,
      least(pa, pb) AS feature_min_prior_fights, pa + pb AS feature_total_prior_fights, round(ln(1 + ma + mb), 6) AS feature_log_total_career_minutes,
      CAST(pa = 0 AND pb = 0 AS INT)::DOUBLE AS feature_both_debutants, CAST((pa = 0) <> (pb = 0) AS INT)::DOUBLE AS feature_exactly_one_debutant FROM pairs""",
)
def shared(spark, sf):
    names = fv.SHARED_FEATURES[:8]
    rows = _rows(spark, sf, names, catch=True)
    out = rows.select("request_id", *[F.get("x_ab", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rounded(out, "feature_log_total_career_minutes")


ROW_NAMES = ("feature_a_minus_b_errors", "feature_min_prior_fights", "feature_odds")


@query(
    "f09_extra_features",
    f"""WITH {PAIR_SQL} SELECT request_id, ea - eb AS v0, least(pa, pb) AS v1, CASE WHEN request_id % 3 = 0 THEN NULL ELSE CAST(request_id % 10 AS DOUBLE) END AS v2,
      CASE WHEN request_id % 3 = 0 THEN 'feature_unusable:feature_odds' END AS error FROM pairs""",
)
def extras(spark, sf):
    extra = F.when(F.col("request_id") % 3 != 0, F.create_map(F.lit("feature_odds"), (F.col("request_id") % 10).cast("double")))
    rows = _rows(spark, sf, ROW_NAMES, extra=extra)
    return rows.select("request_id", *[F.get("x_ab", F.lit(i)).alias(f"v{i}") for i in range(3)], pairing.feature_error(ROW_NAMES).alias("error"))


@query(
    "f11_orientations",
    f"""WITH {PAIR_SQL} SELECT request_id, 'ab' AS orientation, ea - eb AS d, least(pa, pb) AS s FROM pairs UNION ALL SELECT request_id, 'ba', eb - ea, least(pa, pb) FROM pairs""",
)
def orientations(spark, sf):
    return pairing.orientation_rows(_rows(spark, sf, ROW_NAMES[:2]), ["request_id"], "x_ab", "x_ba", ["d", "s"])


@query(
    "f12_out_of_range",
    f"""WITH {PAIR_SQL}, v AS (SELECT request_id, unnest(['feature_a_minus_b_errors', 'feature_min_prior_fights']) AS feature, unnest([ea - eb, least(pa, pb)]) AS x, unnest([eb - ea, least(pa, pb)]) AS y,
       unnest([-1.0, 2.0]) AS lo, unnest([1.0, 30.0]) AS hi FROM pairs)
    SELECT request_id, feature, CAST(lo AS DOUBLE) AS training_min, CAST(hi AS DOUBLE) AS training_max, CASE WHEN x < lo OR x > hi THEN x END AS a_vs_b, CASE WHEN y < lo OR y > hi THEN y END AS b_vs_a FROM v
    WHERE x < lo OR x > hi OR y < lo OR y > hi""",
)
def range_check(spark, sf):
    names = ROW_NAMES[:2]
    ranges = {"feature_a_minus_b_errors": (-1.0, 1.0), "feature_min_prior_fights": (2.0, 30.0)}
    hits = _rows(spark, sf, names).select("request_id", F.explode(pairing.out_of_range(names, ranges)).alias("h"))
    return hits.select("request_id", "h.*")


# --- probabilities and grading ---------------------------------------------------------------


@query(
    "m13_sigmoid",
    "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-greatest(-709, least(709, (l_extendedprice - 40000) / 20)))), 6) AS p FROM lineitem",
)
def sigmoid_link(spark, sf):
    score = (F.col("l_extendedprice") - 40000) / 20
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(sigmoid(score)).alias("p"))


@query(
    "r01_symmetric_probability",
    f"""WITH {fx.SCORED_SQL}, t AS (SELECT l_orderkey, l_linenumber, p, p2 FROM scored)
    SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (p + (1 - p2)) / 2)), 6) AS probability_a, round(1 - greatest(0, least(1, (p + (1 - p2)) / 2)), 6) AS probability_b,
      round(abs(p - (1 - p2)), 6) AS orientation_disagreement FROM t""",
)
def symmetric(spark, sf):
    pa, gap = symmetric_probability(F.col("p"), F.col("p2"))
    return fx.scored(spark, sf).select(
        "l_orderkey", "l_linenumber", r6(pa).alias("probability_a"), r6(1.0 - pa).alias("probability_b"), r6(gap).alias("orientation_disagreement")
    )


@query(
    "r02_winner",
    "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity / 50 - 0.5) <= 1e-12 THEN NULL WHEN l_quantity / 50 > 0.5 THEN 'A' ELSE 'B' END AS winner, abs(l_quantity / 50 - 0.5) <= 1e-12 AS is_even FROM lineitem",
)
def winners(spark, sf):
    p = F.col("l_quantity") / 50
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", serving.winner(p, F.lit("A"), F.lit("B")).alias("winner"), serving.is_even(p).alias("is_even")
    )


GRADE_SQL = """
g AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS pa, CAST(l_quantity AS INT) % 6 AS pb, l_discount * 3 AS gap, CAST(l_extendedprice AS BIGINT) % 900 AS age_a,
   CAST(l_partkey AS BIGINT) % 400 AS age_b, CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_extendedprice AS BIGINT) % 1300 END AS lay_a, CAST(NULL AS BIGINT) AS lay_b,
   l_orderkey % 500 - 50 AS late, CAST(l_quantity AS INT) % 10 AS k, l_suppkey % 4 AS u FROM lineitem),
pen AS (SELECT *, greatest(0, age_a, age_b) AS oldest FROM g),
w AS (SELECT *, CASE WHEN pa = 0 AND pb = 0 THEN 0.42 WHEN pa = 0 OR pb = 0 THEN 0.30 ELSE 0 END::DOUBLE AS r3,
  CASE WHEN least(pa, pb) < 3 THEN 0.14 ELSE 0 END::DOUBLE AS r4, CASE WHEN oldest > 730 THEN 0.25 WHEN oldest > 180 THEN 0.16 ELSE 0 END::DOUBLE AS r5a,
  CASE WHEN coalesce(lay_a, 0) > 1095 THEN 0.13 ELSE 0 END::DOUBLE AS r5b,
  CASE WHEN late <= 0 THEN 0 WHEN late <= 180 THEN 0.03 WHEN late <= 365 THEN 0.07 ELSE 0.15 END::DOUBLE AS r6, CASE WHEN gap >= 0.2 THEN 0.32 WHEN gap >= 0.1 THEN 0.17 ELSE 0 END::DOUBLE AS r7,
  CASE WHEN k > 0 THEN least(0.26, 0.06 + 0.02 * k) ELSE 0 END::DOUBLE AS r8, CASE WHEN u > 1 THEN least(0.55, 0.35 + 0.05 * (u - 2)) ELSE 0 END::DOUBLE AS r9 FROM pen),
s AS (SELECT *, greatest(0, least(1, 1 - r3 - r4 - r5a - r5b - r6 - r7 - r8 - r9)) AS score FROM w)
"""


def _graded(spark, sf):
    line = table(spark, sf, "lineitem")
    whole = F.col("l_extendedprice").cast("bigint")
    whole = F.round("l_extendedprice").cast("bigint")
    count = F.col("l_quantity").cast("int") % 10
    base = line.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_linenumber") - 1).alias("pa"),
        (F.col("l_quantity").cast("int") % 6).alias("pb"),
        (F.col("l_discount") * 3).alias("gap"),
        (whole % 900).alias("age_a"),
        (F.col("l_partkey") % 400).alias("age_b"),
        F.when(F.col("l_suppkey") % 3 > 0, whole % 1300).alias("lay_a"),
        (F.col("l_orderkey") % 500 - 50).alias("late"),
        count.alias("k"),
        (F.col("l_suppkey") % 4).alias("u"),
    )
    outside = f"CAST(IF(k > 0, transform(sequence(1, k), i -> named_struct('feature', concat('f', i), 'a', 0D, 'b', 1D, 'c', 2D, 'd', CAST(NULL AS DOUBLE))), array()) AS {pairing.RANGE_HITS})"
    reasons = pairing.ordered_distinct([F.when(F.col("u") > 1, " one "), F.when(F.col("u") > 1, "one"), F.when(F.col("u") > 2, "two"), F.lit(" ")])
    framed = base.withColumns({"outside": F.expr(outside), "reasons": reasons})
    return with_support_grade(
        framed, prior_a="pa", prior_b="pb", disagreement="gap", snapshot_age_a="age_a", snapshot_age_b="age_b", layoff_a="lay_a",
        layoff_b="CAST(NULL AS BIGINT)", after_cutoff="late", policy=SupportPolicy(),
    )


@query(
    "r10_confidence_score",
    f"""WITH {GRADE_SQL} SELECT l_orderkey, l_linenumber, round(score, 6) AS confidence_score,
    CASE WHEN u > 1 THEN 'unsupported' WHEN score >= 0.85 THEN 'standard' WHEN score >= 0.65 THEN 'reduced' WHEN score >= 0.4 THEN 'low' ELSE 'unsupported' END AS confidence_tier FROM s""",
)
def confidence_score(spark, sf):
    """Penalties R3 to R9 together, clipped and graded."""
    return _graded(spark, sf).select("l_orderkey", "l_linenumber", "confidence_score", "confidence_tier")


@query(
    "r11_warnings",
    f"""WITH {GRADE_SQL} SELECT l_orderkey, l_linenumber, array_to_string(list_filter([
      CASE WHEN r3 > 0.4 THEN 'debut:critical' WHEN r3 > 0 THEN 'debut:warning' END, CASE WHEN r4 > 0 THEN 'limited_history:warning' END, CASE WHEN r5a > 0 OR r5b > 0 THEN 'stale:warning' END,
      CASE WHEN r6 > 0.05 THEN 'after_cutoff:warning' WHEN r6 > 0 THEN 'after_cutoff:info' END, CASE WHEN r7 > 0.3 THEN 'orientation_disagreement:critical' WHEN r7 > 0 THEN 'orientation_disagreement:warning' END,
      CASE WHEN k >= 8 THEN 'out_of_range:critical' WHEN k > 0 THEN 'out_of_range:warning' END, CASE WHEN u > 1 THEN 'unsupported:critical' END], lambda x: x IS NOT NULL), ',') AS codes FROM s""",
)
def warnings(spark, sf):
    codes = F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["severity"])), ",")
    return _graded(spark, sf).select("l_orderkey", "l_linenumber", codes.alias("codes"))


@query(
    "r13_supported_classes",
    f"""WITH {CONTEXT_SQL} SELECT DISTINCT code AS context_class FROM full_ctx WHERE code LIKE 'M\\_%' ESCAPE '\\' OR code LIKE 'W\\_%' ESCAPE '\\' OR code = 'CATCH'""",
)
def supported(spark, sf):
    coded = _context(spark, sf).select(snapshot_class(F.col("label")).alias("division"))
    return supported_classes(coded)


@query(
    "r18_request_hygiene",
    """SELECT doc_id, CASE WHEN length(trim(text, E' \\t\\n\\r')) NOT BETWEEN 1 AND 160 THEN 'invalid_query' WHEN length(source || lang) > 80 THEN 'invalid_class' END AS request_error,
    CASE WHEN doc_id % 2 = 0 THEN lang END AS division FROM documents""",
)
def hygiene(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("query_a"), F.lit(" x ").alias("query_b"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "lang")).otherwise("  ").alias("division")
    )
    return serving.clean_requests(docs).select("doc_id", "request_error", "division")


@query(
    "r19_availability",
    f"WITH {fx.SNAPSHOTS_SQL} SELECT 'ok' AS status, 'run-1' AS artifact_version, DATE '2024-01-31' AS dataset_cutoff, MIN(as_of) AS snapshot_start_date, MAX(as_of) AS snapshot_end_date FROM snaps",
)
def availability(spark, sf):
    return serving.availability(fx.snapshots(spark, sf), run_id="run-1", cutoff="2024-01-31", as_of="as_of")


# --- whole scoring plan with a fixed linear score -----------------------------------------------

FEATURES = (
    "feature_a_minus_b_prior_fights", "feature_a_minus_b_age_years", "feature_a_minus_b_log_layoff_days", "feature_a_minus_b_elo_global",
    "feature_division_lbs", "feature_total_prior_fights", "feature_exactly_one_debutant", "feature_any_age_missing", "feature_mean_elo_global",
)
WEIGHTS = (0.05, -0.02, -0.1, 0.03, 0.001, 0.004, 0.2, 0.1, 0.0002)
RANGES = {"feature_a_minus_b_prior_fights": (-6.0, 6.0), "feature_total_prior_fights": (0.0, 40.0)}
NAMES = fv.Columns(
    entity_id="entity_id", entity_name="name", display_name="shown", as_of="as_of", last_event="last_event", last_class="klass", dob="dob", stance="stance"
)


def scoring_snapshots(spark, sf):
    user = F.col("entity_id")
    return fx.snapshots(spark, sf).withColumns(
        {
            "name": F.concat(F.lit("User "), user.cast("string")),
            "shown": F.lit(None).cast("string"),
            "klass": F.when(user % 3 == 0, "M_LIGHT").when(user % 3 == 1, "Lightweight").otherwise("UNKNOWN"),
            "stance": F.lit("Orthodox"),
            "feature_age_years": F.lit(29.0),
            "feature_elo_global": 1500 + F.col("feature_errors"),
        }
    ).withColumn("entity_id", F.concat(F.lit("u"), user.cast("string")))


def scoring_requests(spark, sf):
    n = F.col("request_id")
    b = F.when(n % 2 == 0, F.concat(F.lit("u"), F.col("b_id").cast("string"))).otherwise(F.concat(F.lit("USER--"), F.col("b_id").cast("string")))
    return fx.requests(spark, sf).select(
        "request_id",
        F.when(n % 50 == 49, "Nobody").otherwise(F.concat(F.lit(" user_"), F.col("a_id").cast("string"))).alias("query_a"),
        b.alias("query_b"),
        F.when(n % 4 == 0, "UFC Lightweight Title Bout").when(n % 4 == 1, "m_light").when(n % 4 == 2, "W_FLY").alias("division"),
        F.col("ref_date").cast("timestamp").alias("predicted_at"),
    )


def scoring_plan() -> ScoringPlan:
    return ScoringPlan(
        features=FEATURES, scorer=LinearScorer(WEIGHTS, -0.8), cutoff="2024-01-10", supported=("M_LIGHT",), ranges=RANGES, columns=NAMES
    )


SCORE_SQL = f"""{POINT_SQL},
rq AS (SELECT *, request_id % 50 = 49 AS lost, CASE request_id % 4 WHEN 0 THEN 'M_LIGHT' WHEN 1 THEN 'M_LIGHT' WHEN 2 THEN 'W_FLY' END AS asked FROM requests),
known AS (SELECT DISTINCT entity_id FROM snaps),
ja AS (SELECT rq.*, s.as_of AS ad, s.dob AS adob, s.last_event AS alast, s.feature_prior_fights AS ap, 1500 + s.feature_errors AS ae,
    CASE s.entity_id % 3 WHEN 0 THEN 'M_LIGHT' WHEN 1 THEN 'Lightweight' ELSE 'UNKNOWN' END AS ac FROM rq ASOF LEFT JOIN snaps s ON rq.a_id = s.entity_id AND rq.ref_date > s.as_of),
jb AS (SELECT ja.*, s.as_of AS bd, s.dob AS bdob, s.last_event AS blast, s.feature_prior_fights AS bp, 1500 + s.feature_errors AS be,
    CASE s.entity_id % 3 WHEN 0 THEN 'M_LIGHT' WHEN 1 THEN 'Lightweight' ELSE 'UNKNOWN' END AS bc FROM ja ASOF LEFT JOIN snaps s ON ja.b_id = s.entity_id AND ja.ref_date > s.as_of),
jc AS (SELECT jb.*, ka.entity_id IS NOT NULL AS ka, kb.entity_id IS NOT NULL AS kb,
    coalesce(asked, CASE WHEN ac = bc AND ac <> 'UNKNOWN' THEN 'M_LIGHT' END) AS code FROM jb LEFT JOIN known ka ON ka.entity_id = a_id LEFT JOIN known kb ON kb.entity_id = b_id),
f AS (SELECT *, CASE WHEN lost OR NOT ka THEN 'not_found' WHEN NOT kb THEN 'not_found' WHEN a_id = b_id THEN 'same_entity' WHEN ad IS NULL OR bd IS NULL THEN 'snapshot_unavailable'
      WHEN code IS NULL THEN 'class_required' END AS error_code,
    CASE WHEN adob IS NULL THEN 29 ELSE date_diff('day', adob, ref_date) / 365.2425 END AS aa, CASE WHEN bdob IS NULL THEN 29 ELSE date_diff('day', bdob, ref_date) / 365.2425 END AS ba,
    date_diff('day', alast, ref_date) AS al, date_diff('day', blast, ref_date) AS bl FROM jc),
x AS (SELECT *, 0.05 * (ap - bp) - 0.02 * (aa - ba) - 0.1 * (ln(1 + coalesce(al, 365)) - ln(1 + coalesce(bl, 365))) + 0.03 * (ae - be) AS odd,
    0.001 * CASE WHEN code = 'W_FLY' THEN 125 ELSE 155 END + 0.004 * (ap + bp) + 0.2 * CAST((ap = 0) <> (bp = 0) AS INT) + 0.1 * CAST(adob IS NULL OR bdob IS NULL AS INT) + 0.0002 * (ae + be) / 2 - 0.8 AS even FROM f),
pr AS (SELECT *, 1 / (1 + exp(-(even + odd))) AS pab, 1 / (1 + exp(-(even - odd))) AS pba FROM x),
pp AS (SELECT *, (pab + 1 - pba) / 2 AS p, abs(pab - (1 - pba)) AS gap, greatest(0, date_diff('day', DATE '2024-01-10', ref_date)) AS late,
    CAST(abs(ap - bp) > 6 AS INT) + CAST(ap + bp > 40 AS INT) AS k, CAST(code <> 'M_LIGHT' AS INT) AS u, greatest(date_diff('day', ad, ref_date), date_diff('day', bd, ref_date)) AS oldest FROM pr),
sc AS (SELECT *, 1 - CASE WHEN ap = 0 AND bp = 0 THEN 0.42 WHEN ap = 0 OR bp = 0 THEN 0.30 ELSE 0 END - CASE WHEN least(ap, bp) < 3 THEN 0.14 ELSE 0 END
    - CASE WHEN oldest > 730 THEN 0.25 WHEN oldest > 180 THEN 0.16 ELSE 0 END - CASE WHEN greatest(al, bl) > 1095 THEN 0.13 ELSE 0 END
    - CASE WHEN late <= 0 THEN 0 WHEN late <= 180 THEN 0.03 WHEN late <= 365 THEN 0.07 ELSE 0.15 END - CASE WHEN gap >= 0.2 THEN 0.32 WHEN gap >= 0.1 THEN 0.17 ELSE 0 END
    - CASE WHEN k > 0 THEN least(0.26, 0.06 + 0.02 * k) ELSE 0 END - CASE WHEN u > 0 THEN 0.35 ELSE 0 END AS raw_score FROM pp),
done AS (SELECT request_id, error_code, CASE WHEN error_code IS NULL THEN code END AS division, CASE WHEN error_code IS NULL THEN ad END AS snapshot_date_a, CASE WHEN error_code IS NULL THEN bd END AS snapshot_date_b,
    CASE WHEN error_code IS NULL THEN round(p, 6) END AS probability_a, CASE WHEN error_code IS NULL THEN round(gap, 6) END AS orientation_disagreement,
    CASE WHEN error_code IS NULL THEN round(greatest(0, least(1, CAST(raw_score AS DOUBLE))), 6) END AS confidence_score,
    CASE WHEN error_code IS NOT NULL THEN NULL WHEN u > 0 THEN 'unsupported' WHEN raw_score >= 0.85 THEN 'standard' WHEN raw_score >= 0.65 THEN 'reduced' WHEN raw_score >= 0.4 THEN 'low' ELSE 'unsupported' END AS confidence_tier,
    CASE WHEN error_code IS NOT NULL OR abs(p - 0.5) <= 1e-12 THEN NULL WHEN p > 0.5 THEN 'User ' || a_id ELSE 'User ' || b_id END AS predicted_winner_name FROM sc)
"""
SCORE_COLUMNS = (
    "request_id", "error_code", "division", "snapshot_date_a", "snapshot_date_b", "probability_a", "orientation_disagreement", "confidence_score",
    "confidence_tier", "predicted_winner_name",
)


def scored(spark, sf):
    return score_requests(scoring_requests(spark, sf), scoring_snapshots(spark, sf), scoring_plan())


@query("w04_score_requests", f"WITH {SCORE_SQL} SELECT {', '.join(SCORE_COLUMNS)} FROM done")
def score_all(spark, sf):
    return rounded(scored(spark, sf).select(*SCORE_COLUMNS), "probability_a", "orientation_disagreement")


@query(
    "w05_request_stream",
    f"""WITH {SCORE_SQL} SELECT {', '.join('d.' + c for c in SCORE_COLUMNS)}, r.a_id % 2 AS batch_id FROM done d JOIN requests r USING (request_id)""",
)
def stream_requests(spark, sf):
    """Two micro-batches over one published version of the snapshots."""
    root = scratch(spark, "stream")
    published = publish(scoring_snapshots(spark, sf), f"{root}/snapshots", "1", columns=NAMES, buckets=16)
    asked = scoring_requests(spark, sf)
    known = fx.requests(spark, sf).select("request_id", (F.col("a_id") % 2).alias("batch_id"))
    split = asked.join(known, "request_id")
    for part in (0, 1):
        split.where(F.col("batch_id") == part).drop("batch_id").coalesce(1).write.parquet(f"{root}/in/part={part}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    for part in (0, 1):  # a folder is a source of its own, so that a batch is what it is meant to be
        stream = read_requests(spark, f"{root}/in/part={part}", schema, kind="parquet")
        score_stream(stream, published, scoring_plan(), f"{root}/out/{part}", checkpoint=f"{root}/marks/{part}").awaitTermination()
    found = []
    for part in (0, 1):
        good = spark.read.parquet(f"{root}/out/{part}/predictions").withColumn("error_code", F.lit(None).cast("string"))
        bad = spark.read.parquet(f"{root}/out/{part}/rejected").select("request_id", "error_code")
        both = good.select(*SCORE_COLUMNS).unionByName(bad, allowMissingColumns=True)
        found.append(both.withColumn("batch_id", F.lit(part).cast("bigint")))
    return rounded(found[0].unionByName(found[1]), "probability_a", "orientation_disagreement")


@query("r14_prediction_record")
def full_record(spark, sf):
    return split_outcomes(scored(spark, sf))[0]


@query(
    "r15_public_predictions",
    f"""WITH {SCORE_SQL} SELECT d.request_id, d.division, probability_a, 'User ' || a_id AS name_a, 'User ' || b_id AS shown_b, d.confidence_tier AS tier FROM done d JOIN requests r USING (request_id) WHERE error_code IS NULL""",
)
def public(spark, sf):
    shown = serving.public_predictions(split_outcomes(scored(spark, sf))[0], keep=["request_id"])
    return shown.select(
        "request_id", "division", r6("probability_a").alias("probability_a"), F.col("fighter_a.fighter_name").alias("name_a"),
        F.col("fighter_b.display_name").alias("shown_b"), F.col("confidence.tier").alias("tier"),
    )


@query(
    "r17_rejections",
    f"""WITH {SCORE_SQL}, span AS (SELECT entity_id, MIN(as_of) AS lo, MAX(as_of) AS hi FROM snaps GROUP BY 1),
    bad AS (SELECT d.request_id, d.error_code, r.ref_date, CASE WHEN d.error_code = 'snapshot_unavailable' THEN CASE WHEN x.ad IS NULL THEN r.a_id ELSE r.b_id END END AS who
      FROM done d JOIN requests r USING (request_id) JOIN jb x USING (request_id) WHERE d.error_code IS NOT NULL)
    SELECT request_id, error_code, CASE error_code WHEN 'same_entity' THEN 'Choose two different fighters.' WHEN 'not_found' THEN 'No fighter matched ''Nobody''' WHEN 'class_required' THEN 'division is required when it cannot be inferred from both snapshots' WHEN 'snapshot_unavailable' THEN 'User ' || who ||
       ' has no snapshot available before the current server date (' || ref_date || '). Available snapshot dates run from ' || lo || ' through ' || hi || '.'
       ELSE 'The prediction service could not complete this request. Please try again later.' END AS error_message
    FROM bad LEFT JOIN span ON who = entity_id""",
)
def rejections(spark, sf):
    _, rejected = split_outcomes(scored(spark, sf).persist())
    out = rejection_table(rejected, scoring_snapshots(spark, sf), columns=NAMES)
    return out.select("request_id", "error_code", "error_message")


MESSAGES_SQL = """
names AS (SELECT entity_id, CASE WHEN trim(coalesce(display, '')) = '' THEN trim(name) ELSE trim(display) END AS shown FROM entities),
lists AS (SELECT name_key, string_agg(shown, ', ' ORDER BY entity_id) AS shown FROM idx JOIN names USING (entity_id) GROUP BY name_key),
asked AS (SELECT p_partkey AS request_id, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name_key, p_partkey % 7 AS kind, substr(md5(p_name), 1, 16) AS token FROM part)
"""


@query(
    "r17_lookup_messages",
    f"""WITH {ENTITIES_SQL}, {MESSAGES_SQL}
    SELECT request_id, CASE kind
      WHEN 0 THEN 'More than one fighter matches that name. Use a more specific full name.' || coalesce(' Matches: ' || lists.shown || '.', '')
      WHEN 1 THEN 'No fighter matched ''zq' || md5(p_name) || ''''
      WHEN 2 THEN '''' || p_name || ''' does not refer to fighter_id ''Unknown Fighter'''
      WHEN 3 THEN 'unsupported division ''Type ' || request_id || '''; supply division_lbs and is_womens to score it explicitly'
      WHEN 4 THEN 'The current server date is after the model cutoff and post-cutoff prediction is disabled'
      WHEN 5 THEN 'fighter A''s snapshot stores division-specific ratings for M_FLY, not requested division M_LIGHT; per-division history is required to score a division change'
      ELSE 'No fighter matched ''Unknown Fighter''' END AS error_message
    FROM asked LEFT JOIN lists USING (name_key)""",
)
def lookup_messages(spark, sf):
    """Messages of requests that failed before scoring: lists of names, quoted requests, ids replaced."""
    kind = F.col("p_partkey") % 7
    codes = ("ambiguous", "not_found", "identity_mismatch", "class_unsupported", "post_cutoff_disabled", "class_state_mismatch", "not_found")
    token = F.substring(F.md5("p_name"), 1, 16)
    none = F.lit(None)
    lost = F.concat(F.lit("zq"), F.md5("p_name"))
    rejected = table(spark, sf, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.element_at(F.array(*[F.lit(x) for x in codes]), (kind + 1).cast("int")).alias("error_code"),
        none.cast("string").alias("query_a"), none.cast("string").alias("query_b"), none.cast("date").alias("ref_date"),
        none.cast("string").alias("failed_entity_id"), none.cast("date").alias("available_first"), none.cast("date").alias("available_last"),
        F.when(kind == 1, lost).otherwise(F.col("p_name")).alias("failed_query"),
        F.when(kind.isin(2, 6), token).alias("failed_id"),
        F.lit("fighter A").alias("failed_side"), F.lit("M_FLY").alias("failed_state"),
        F.concat(F.lit("Type "), F.col("p_partkey").cast("string")).alias("failed_label"), F.lit("M_LIGHT").alias("failed_class"),
        none.cast("struct<n:bigint,day:date>").alias("failed_repeats"),
    )
    people = entities(spark, sf).withColumn("as_of", F.lit("2024-01-01").cast("date"))
    columns = fv.Columns(entity_id="entity_id", entity_name="name", display_name="display", as_of="as_of")
    return rejection_table(rejected, people, columns=columns).select("request_id", "error_message")
