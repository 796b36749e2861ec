"""Q2-Q20: data-quality findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.operators import quality as q
from duelframe.registry import fixtures as fx
from duelframe.registry.base import as_bigint, query, table


def _flat(findings):
    """Findings with the example list as one text."""
    return findings.select("check", "column", F.col("bad_count").cast("bigint").alias("bad_count"), F.array_join("examples", ",").alias("examples"))


def _row_sql(check: str, column: str, bad: str, source: str) -> str:
    """Findings of one check, given a relation `bad(example)` of the wrong rows."""
    return f"""
    SELECT '{check}' AS "check", '{column}' AS "column", (SELECT CAST(COUNT(*) AS BIGINT) FROM {bad}) AS bad_count,
      coalesce((SELECT string_agg(example, ',' ORDER BY example) FROM (SELECT DISTINCT example FROM {bad} WHERE example IS NOT NULL ORDER BY example LIMIT 10)), '') AS examples
    {source}"""


def _count_sql(check: str, conditions: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{check}' AS "check", '{name}' AS "column", COUNT(*) FILTER ({cond}) AS bad_count, '' AS examples FROM {source}"""
        for name, cond in conditions.items()
    )


NAMES_SQL = f"""
names AS (
  SELECT CASE p_size % 5 WHEN 0 THEN 'f1_' WHEN 1 THEN ' Target_' WHEN 2 THEN 'feature_' WHEN 3 THEN 'Post_Fight_' ELSE '' END
      || replace(p_name, ' ', '_') AS name FROM part
  UNION ALL
  SELECT list_element({list(fv.LEAK_NAMES)!r}, CAST(p_partkey % {len(fv.LEAK_NAMES)} + 1 AS INT)) || CASE WHEN p_size > 25 THEN '_x' ELSE '' END FROM part)
"""


@query(
    "q02_leak_names",
    f"""WITH {NAMES_SQL}, w AS (SELECT name, lower(trim(name)) AS word FROM names)
    SELECT name, COUNT(*) AS n FROM w
    WHERE word <> 'target_small_ring' AND (starts_with(word, 'target_') OR list_contains({list(fv.LEAK_NAMES)!r}, word)
      OR {" OR ".join(f"regexp_matches(word, '{p}')" for p in fv.LEAK_PATTERNS)}) GROUP BY name""",
)
def leak_names(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size") % 5
    prefix = F.when(size == 0, "f1_").when(size == 1, " Target_").when(size == 2, "feature_").when(size == 3, "Post_Fight_").otherwise("")
    built = part.select(F.concat(prefix, F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    words = F.array(*[F.lit(w) for w in fv.LEAK_NAMES])
    pick = F.element_at(words, (F.col("p_partkey") % len(fv.LEAK_NAMES) + 1).cast("int"))
    listed = part.select(F.concat(pick, F.when(F.col("p_size") > 25, "_x").otherwise("")).alias("name"))
    names = built.unionByName(listed)
    return q.leak_names(names, "name", target="target_small_ring").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q03_null_counts",
    "WITH t AS (SELECT nullif(o_orderpriority, '5-LOW') AS class, nullif(o_orderstatus, 'P') AS status, o_custkey AS a_id FROM orders) "
    + _count_sql("null_value", {"class": "class IS NULL", "status": "status IS NULL", "a_id": "a_id IS NULL"}, "t"),
)
def null_counts(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("class"),
        F.expr("nullif(o_orderstatus, 'P')").alias("status"),
        F.col("o_custkey").alias("a_id"),
    )
    return _flat(q.null_counts(orders, ["class", "status", "a_id"]))


@query(
    "q04_duplicate_keys",
    """WITH d AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1),
    e AS (SELECT DISTINCT l_orderkey || '|' || l_linenumber AS example FROM d ORDER BY 1 LIMIT 10)
    SELECT 'duplicate_key' AS "check", 'l_orderkey|l_linenumber' AS "column", (SELECT CAST(coalesce(SUM(n), 0) AS BIGINT) FROM d) AS bad_count,
      (SELECT string_agg(example, ',' ORDER BY example) FROM e) AS examples""",
)
def duplicate_keys(spark, sf):
    return _flat(q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query(
    "q05_self_pairs",
    f"WITH {fx.CONTESTS_SQL}, bad AS (SELECT CAST(a_id AS VARCHAR) AS example FROM contests WHERE a_id = b_id)"
    + _row_sql("self_pair", "a_id", "bad", ""),
)
def self_pairs(spark, sf):
    return _flat(q.self_pairs(fx.contests(spark, sf), "a_id", "b_id"))


TARGET_SQL = """t AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN '0' WHEN '3-MEDIUM' THEN '2'
    WHEN '4-NOT SPECIFIED' THEN 'yes' END AS target FROM orders)"""


@query(
    "q06_binary_target",
    f"""WITH {TARGET_SQL}, c AS (SELECT COUNT(*) FILTER (target IS NULL) AS a, COUNT(*) FILTER (target IS NOT NULL AND try_cast(target AS DOUBLE) IS NULL) AS b,
      COUNT(*) FILTER (try_cast(target AS DOUBLE) NOT IN (0, 1)) AS c,
      CAST(COUNT(*) FILTER (try_cast(target AS DOUBLE) = 0) = 0 AS BIGINT) + CAST(COUNT(*) FILTER (try_cast(target AS DOUBLE) = 1) = 0 AS BIGINT) AS d FROM t)
    SELECT unnest(['target_null', 'target_not_numeric', 'target_not_binary', 'target_class_absent']) AS "check", 'target' AS "column",
      unnest([a, b, c, d]) AS bad_count, '' AS examples FROM c""",
)
def binary_target(spark, sf):
    p = F.col("o_orderpriority")
    target = F.when(p == "1-URGENT", "1").when(p == "2-HIGH", "0").when(p == "3-MEDIUM", "2").when(p == "4-NOT SPECIFIED", "yes")
    return _flat(q.binary_target(table(spark, sf, "orders").select(target.alias("target")), "target"))


MATRIX_SQL = """t AS (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS feature_a,
    CASE WHEN l_linenumber = 4 THEN 'Infinity'::DOUBLE WHEN l_linenumber = 5 THEN 'NaN'::DOUBLE ELSE l_tax END AS feature_b, l_returnflag AS feature_c FROM lineitem)"""


@query(
    "q07_feature_matrix",
    f"""WITH {MATRIX_SQL} SELECT 'feature_not_numeric' AS "check", 'feature_c' AS "column", CAST(1 AS BIGINT) AS bad_count, '' AS examples UNION ALL """
    + _count_sql("feature_null", {"feature_a": "feature_a IS NULL OR isnan(feature_a)", "feature_b": "feature_b IS NULL OR isnan(feature_b)"}, "t")
    + " UNION ALL "
    + _count_sql("feature_not_finite", {"feature_a": "isinf(feature_a)", "feature_b": "isinf(feature_b)"}, "t"),
)
def feature_matrix(spark, sf):
    line = F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(
        F.when(line != 3, F.col("l_discount")).alias("feature_a"),
        F.when(line == 4, float("inf")).when(line == 5, float("nan")).otherwise(F.col("l_tax")).alias("feature_b"),
        F.col("l_returnflag").alias("feature_c"),
    )
    return _flat(q.feature_matrix(df, ["feature_a", "feature_b", "feature_c"]))


@query(
    "q08_expected_counts",
    """SELECT 'feature_count' AS "check", '*' AS "column", CAST(69 AS BIGINT) AS bad_count, '' AS examples
    UNION ALL SELECT 'row_count', '*', abs(COUNT(*) - 8116), '' FROM orders""",
)
def expected_counts(spark, sf):
    features = ["feature_price", "feature_priority"]
    return _flat(q.expected_counts(fx.contests(spark, sf), features, rows=8116, feature_count=71))


@query(
    "q09_after_cutoff",
    f"WITH {fx.CONTESTS_SQL}, bad AS (SELECT CAST(event_date AS VARCHAR) AS example FROM contests WHERE event_date > DATE '2001-06-01')"
    + _row_sql("after_cutoff", "event_date", "bad", ""),
)
def after_cutoff(spark, sf):
    return _flat(q.after_cutoff(fx.contests(spark, sf), "event_date", "2001-06-01"))


@query(
    "q10_dataset_evidence",
    f"""WITH {fx.CONTESTS_SQL} SELECT COUNT(*) AS row_count, 2 AS feature_count, COUNT(*) FILTER (target = 1) AS positive_count,
    COUNT(*) FILTER (target = 0) AS negative_count, MIN(event_date) AS first_event_date, MAX(event_date) AS last_event_date FROM contests""",
)
def dataset_evidence(spark, sf):
    features = ["feature_price", "feature_priority"]
    return q.dataset_evidence(fx.contests(spark, sf), target="target", date="event_date", features=features)


# A feature dictionary with as many rows as the part table, most of them faulty.
DICTIONARY_SQL = """
dictionary AS (
  SELECT p_partkey AS position, CASE WHEN p_partkey = 7 THEN 'target_a_win' ELSE 'feature_' || replace(p_name, ' ', '_') || '_' || (p_partkey % 700) END AS "column",
    CASE WHEN p_partkey = 7 THEN 'target' WHEN p_size % 3 = 0 THEN 'metadata' ELSE 'model_feature' END AS role,
    CASE WHEN p_partkey = 7 THEN 'no' WHEN p_size < 20 THEN ' TRUE ' WHEN p_size < 40 THEN '1' WHEN p_size < 45 THEN 'No' ELSE 'maybe' END AS available_pre_fight,
    p_type AS description FROM part)
"""


def dictionary(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        key.alias("position"),
        F.when(key == 7, "target_a_win")
        .otherwise(F.concat(F.lit("feature_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (key % 700).cast("string")))
        .alias("column"),
        F.when(key == 7, "target").when(size % 3 == 0, "metadata").otherwise("model_feature").alias("role"),
        F.when(key == 7, "no").when(size < 20, " TRUE ").when(size < 40, "1").when(size < 45, "No").otherwise("maybe").alias("available_pre_fight"),
        F.col("p_type").alias("description"),
    )


@query(
    "q11_dictionary",
    f"""WITH {DICTIONARY_SQL}, b AS (SELECT *, CASE WHEN lower(trim(available_pre_fight)) IN ('1', 'true', 'yes') THEN true
       WHEN lower(trim(available_pre_fight)) IN ('0', 'false', 'no') THEN false END AS ok FROM dictionary),
    dup AS (SELECT "column" AS example, COUNT(*) AS n FROM b GROUP BY 1 HAVING COUNT(*) > 1)
    SELECT "check", "column", bad_count, examples FROM (
    {_count_sql("null_name", {"column": '"column" IS NULL'}, "b")}
    UNION ALL SELECT 'target_not_once', 'column', abs(COUNT(*) FILTER ("column" = 'target_a_win') - 1), '' FROM b
    UNION ALL {_count_sql("target_role", {"column": "\"column\" = 'target_a_win' AND role <> 'target'"}, "b")}
    UNION ALL {_count_sql("target_available", {"column": "\"column\" = 'target_a_win' AND ok"}, "b")}
    UNION ALL {_count_sql("bad_boolean", {"column": "(role = 'model_feature' OR \"column\" = 'target_a_win') AND ok IS NULL"}, "b")}
    UNION ALL {_count_sql("feature_unavailable", {"column": "role = 'model_feature' AND NOT ok"}, "b")}
    UNION ALL SELECT 'no_features', 'column', CAST(COUNT(*) FILTER (role = 'model_feature') = 0 AS BIGINT), '' FROM b
    UNION ALL SELECT 'duplicate_name', 'column', CAST((SELECT coalesce(SUM(n), 0) FROM dup) AS BIGINT),
       coalesce((SELECT string_agg(example, ',' ORDER BY example) FROM (SELECT example FROM dup ORDER BY 1 LIMIT 10)), '')
    UNION ALL SELECT 'leak_column', 'column', CAST(0 AS BIGINT), '')""",
)
def dictionary_check(spark, sf):
    return _flat(q.dictionary_findings(dictionary(spark, sf), target="target_a_win"))


@query(
    "q12_snapshot_nulls",
    f"WITH {fx.SNAPSHOTS_SQL} "
    + _count_sql("null_value", {"entity_id": "entity_id IS NULL", "as_of": "as_of IS NULL", "dob": "dob IS NULL", "last_event": "last_event IS NULL"}, "snaps"),
)
def snapshot_nulls(spark, sf):
    return _flat(q.null_counts(fx.snapshots(spark, sf), ["entity_id", "as_of", "dob", "last_event"]))


@query(
    "q13_snapshot_duplicates",
    f"""WITH {fx.SNAPSHOTS_SQL}, d AS (SELECT CAST(entity_id AS VARCHAR) AS example, COUNT(*) AS n FROM snaps GROUP BY 1 HAVING COUNT(*) > 1)
    SELECT 'duplicate_key' AS "check", 'entity_id' AS "column", (SELECT CAST(coalesce(SUM(n), 0) AS BIGINT) FROM d) AS bad_count,
      (SELECT string_agg(example, ',' ORDER BY example) FROM (SELECT example FROM d ORDER BY 1 LIMIT 10)) AS examples""",
)
def snapshot_duplicates(spark, sf):
    return _flat(q.duplicate_keys(fx.snapshots(spark, sf), ["entity_id"]))


@query(
    "q14_common_as_of",
    f"""WITH {fx.SNAPSHOTS_SQL}, s AS (SELECT COUNT(DISTINCT as_of) AS d, MIN(as_of) AS lo, MAX(as_of) AS hi FROM snaps)
    SELECT 'as_of_not_common' AS "check", 'as_of' AS "column", d - 1 AS bad_count, '' AS examples FROM s
    UNION ALL SELECT 'as_of_not_expected', 'as_of', CAST(lo <> DATE '2024-01-31' OR hi <> DATE '2024-01-31' AS BIGINT), '' FROM s""",
)
def common_as_of(spark, sf):
    return _flat(q.common_as_of(fx.snapshots(spark, sf), "as_of", expected="2024-01-31"))


@query(
    "q15_event_after_as_of",
    f"""WITH {fx.SNAPSHOTS_SQL}, moved AS (SELECT entity_id, as_of, last_event + CAST(entity_id % 5 AS INT) AS last_event FROM snaps),
    bad AS (SELECT entity_id || '|' || last_event AS example FROM moved WHERE last_event > as_of)"""
    + _row_sql("event_after_as_of", "last_event", "bad", ""),
)
def event_after_as_of(spark, sf):
    moved = fx.snapshots(spark, sf).withColumn("last_event", F.date_add("last_event", (F.col("entity_id") % 5).cast("int")))
    return _flat(q.later_than(moved, "last_event", "as_of", "entity_id", check="event_after_as_of"))


@query(
    "q16_birth_after_as_of",
    f"""WITH {fx.SNAPSHOTS_SQL}, bad AS (SELECT entity_id || '|' || (dob + 11000) AS example FROM snaps WHERE dob + 11000 > as_of)"""
    + _row_sql("birth_after_as_of", "dob", "bad", ""),
)
def birth_after_as_of(spark, sf):
    moved = fx.snapshots(spark, sf).withColumn("dob", F.date_add("dob", 11000))
    return _flat(q.later_than(moved, "dob", "as_of", "entity_id", check="birth_after_as_of"))


@query(
    "q17_strict_dates",
    """WITH t AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' || (o_orderkey % 40) WHEN o_orderkey % 11 = 0 THEN NULL
       WHEN o_orderkey % 13 = 0 THEN '2001-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders),
    bad AS (SELECT d AS example FROM t WHERE d IS NOT NULL AND try_cast(d AS DATE) IS NULL)"""
    + _row_sql("date_unparseable", "d", "bad", "")
    + " UNION ALL "
    + _count_sql("date_null", {"d": "d IS NULL"}, "t"),
)
def strict_dates(spark, sf):
    key = F.col("o_orderkey")
    d = (
        F.when(key % 7 == 0, F.concat(F.lit("n/a "), (key % 40).cast("string")))
        .when(key % 11 == 0, F.lit(None))
        .when(key % 13 == 0, "2001-02-30")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    df = table(spark, sf, "orders").select(d.alias("d"))
    return _flat(q.strict_dates(df, "d", F.try_to_date("d", "yyyy-MM-dd"), allow_null=False))


@query(
    "q18_snapshot_features",
    f"""WITH {fx.SNAPSHOTS_SQL}, t AS (SELECT feature_prior_fights / nullif(feature_errors, 0) AS feature_ratio, feature_career_minutes FROM snaps) """
    + _count_sql("feature_null", {"feature_ratio": "feature_ratio IS NULL", "feature_career_minutes": "feature_career_minutes IS NULL"}, "t")
    + " UNION ALL "
    + _count_sql("feature_not_finite", {"feature_ratio": "isinf(feature_ratio)", "feature_career_minutes": "isinf(feature_career_minutes)"}, "t"),
)
def snapshot_features(spark, sf):
    ratio = F.try_divide("feature_prior_fights", "feature_errors").alias("feature_ratio")
    df = fx.snapshots(spark, sf).select(ratio, "feature_career_minutes")
    return _flat(q.feature_matrix(df, ["feature_ratio", "feature_career_minutes"]))


@query(
    "q19_snapshot_evidence",
    f"""WITH {fx.SNAPSHOTS_SQL} SELECT COUNT(*) AS entity_count, 5 AS feature_count, MAX(as_of) AS as_of_date, MAX(last_event) AS last_recorded_event_date FROM snaps""",
)
def snapshot_evidence(spark, sf):
    snaps = fx.snapshots(spark, sf)
    features = [c for c in snaps.columns if c.startswith("feature_")]
    return as_bigint(q.snapshot_evidence(snaps, as_of="as_of", last_event="last_event", features=features), "entity_count")


@query(
    "q20_id_set_difference",
    """WITH a AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey <> 3),
    b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing_right' ELSE 'missing_left' END AS finding
    FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""",
)
def id_sets(spark, sf):
    customers = table(spark, sf, "customer").where("c_nationkey <> 3")
    orders = table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'")
    return q.id_set_difference(customers, orders, "c_custkey", "o_custkey")
