"""Feature catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.operators import catalogue as c
from duelframe.registry import fixtures as fx
from duelframe.registry.base import as_bigint, query, r6, rounded, table
from duelframe.registry.data_checks import DICTIONARY_SQL, dictionary

# every distinct word of the documents stands for a column name
WORDS_SQL = r"""
words AS (SELECT DISTINCT word AS feature FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z_]+')) AS word FROM documents) WHERE word <> '')
"""


def words(spark, sf, where="true"):
    text = table(spark, sf, "documents").where(where).select(F.explode(F.split(F.lower("text"), "[^a-z_]+")).alias("feature"))
    return text.where("feature <> ''").distinct()


def _contains(column: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


GROUP_SQL = "CASE " + " ".join(f"WHEN {_contains('{x}', tokens)} THEN '{g}'" for g, tokens in fv.FEATURE_GROUP_RULES) + " ELSE 'other' END"


@query(
    "c01_catalogue_from_dictionary",
    f"""WITH {DICTIONARY_SQL} SELECT position, "column" AS feature, {GROUP_SQL.replace('{x}', 'lower("column")')} AS feature_group,
    CASE WHEN lower(trim(available_pre_fight)) IN ('1', 'true', 'yes') THEN true WHEN lower(trim(available_pre_fight)) IN ('0', 'false', 'no') THEN false END AS available,
    description FROM dictionary WHERE role = 'model_feature'""",
)
def from_dictionary(spark, sf):
    return c.catalogue_from_dictionary(dictionary(spark, sf))


@query(
    "c02_discover_features",
    """SELECT 'feature_price' AS feature, COUNT(o_totalprice) AS filled FROM orders
    UNION ALL SELECT 'feature_priority', COUNT(o_orderpriority) FROM orders""",
)
def discover(spark, sf):
    contests = fx.contests(spark, sf)
    names = c.discover_features(contests)
    one_row = contests.agg(*[F.count(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("filled")) for n in names])
    return one_row.select(F.explode(pairs).alias("x")).select("x.*")


@query(
    "c03_name_mismatch",
    r"""SELECT feature, CASE WHEN bool_or(lang = 'en') THEN 'missing' ELSE 'unexpected' END AS finding
    FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z_]+')) AS feature FROM documents)
    GROUP BY feature HAVING bool_or(lang = 'en') <> bool_or(lang <> 'en')""",
)
def mismatch(spark, sf):
    """Words of one language against the words of all others."""
    return c.name_mismatch(words(spark, sf, "lang = 'en'"), words(spark, sf, "lang <> 'en'"))


@query(
    "c04_select_matrix",
    f"WITH {fx.CONTESTS_SQL} SELECT contest_id, feature_priority, round(feature_price, 6) AS feature_price FROM contests",
)
def matrix(spark, sf):
    return rounded(c.select_matrix(fx.contests(spark, sf), ["feature_priority", "feature_price"], keep=["contest_id"]), "feature_price")


@query("c05_feature_groups", f"WITH {WORDS_SQL} SELECT {GROUP_SQL.replace('{x}', 'feature')} AS feature_group, COUNT(*) AS n FROM words GROUP BY 1")
def groups(spark, sf):
    return words(spark, sf).groupBy(c.feature_group("feature").alias("feature_group")).agg(F.count(F.lit(1)).alias("n"))


ABLATION_SQL = " UNION ALL ".join(
    f"SELECT '{g}' AS ablation_group, feature FROM words WHERE {_contains('feature', inc)}" + (f" AND NOT {_contains('feature', exc)}" if exc else "")
    for g, inc, exc in fv.ABLATION_RULES
)


@query("c06_ablation_groups", f"WITH {WORDS_SQL} {ABLATION_SQL}")
def ablation(spark, sf):
    return c.ablation_members(words(spark, sf).withColumn("position", F.lit(0))).drop("position")


@query(
    "c07_catalogue_digest",
    f"""WITH f AS (SELECT DISTINCT 'feature_' || lower(p_type) || '_' || lower(replace(p_brand, '#', '')) AS feature FROM part),
    o AS (SELECT feature, {GROUP_SQL.replace('{x}', 'feature')} AS g, row_number() OVER (ORDER BY feature) AS pos FROM f)
    SELECT sha256(string_agg(feature || chr(31) || g || chr(31) || '1' || chr(30), '' ORDER BY pos)) AS catalogue_sha256 FROM o""",
)
def digest(spark, sf):
    # distinct types and brands: a list as short as the list of features of a table
    feature = F.concat(F.lit("feature_"), F.lower("p_type"), F.lit("_"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    names = table(spark, sf, "part").select(feature.alias("feature")).distinct()
    framed = names.select(F.col("feature").alias("position"), "feature", c.feature_group("feature").alias("feature_group"), F.lit(True).alias("available"))
    return c.catalogue_digest(framed)


@query(
    "c09_training_ranges",
    f"""WITH {fx.SCORED_SQL}, t AS (SELECT * FROM scored WHERE event_date <= DATE '{fx.TRAIN_END}')
    SELECT unnest(['p', 'p2', 'prior']) AS feature, round(unnest([MIN(p), MIN(p2), MIN(prior)]), 6) AS lo, round(unnest([MAX(p), MAX(p2), MAX(prior)]), 6) AS hi FROM t""",
)
def ranges(spark, sf):
    train = fx.scored(spark, sf).where(F.col("event_date") <= F.lit(fx.TRAIN_END).cast("date"))
    return rounded(c.training_ranges(train, ["p", "p2", "prior"]), "lo", "hi")
