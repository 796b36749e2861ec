"""Chronological splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.operators import splits as sp
from duelframe.registry import fixtures as fx
from duelframe.registry.base import query, r6, table
from duelframe.registry.data_checks import _count_sql, _flat

BOUNDS = sp.SplitBounds(fx.TRAIN_END, fx.VALIDATION_START, fx.VALIDATION_END, fx.TEST_START, fx.CUTOFF)
LABEL_SQL = f"""CASE WHEN event_date <= DATE '{fx.TRAIN_END}' THEN 'train'
    WHEN event_date BETWEEN DATE '{fx.VALIDATION_START}' AND DATE '{fx.VALIDATION_END}' THEN 'validation'
    WHEN event_date BETWEEN DATE '{fx.TEST_START}' AND DATE '{fx.CUTOFF}' THEN 'test' END"""
BOUNDED_SQL = f"{fx.CONTESTS_SQL}, labelled AS (SELECT *, {LABEL_SQL} AS split FROM contests)"


@query(
    "p01_fraction_split",
    f"""WITH {fx.CONTESTS_SQL},
    per_date AS (SELECT event_date AS day, COUNT(*) AS n FROM contests GROUP BY 1),
    cum AS (SELECT day, n, SUM(n) OVER (ORDER BY day) AS running, row_number() OVER (ORDER BY day) - 1 AS pos, SUM(n) OVER () AS total, COUNT(*) OVER () AS dates FROM per_date),
    t AS (SELECT pos, day FROM cum WHERE pos <= dates - 3 ORDER BY abs(running - total * 0.7::DOUBLE), pos LIMIT 1),
    v AS (SELECT cum.day FROM cum, t WHERE cum.pos > t.pos AND cum.pos <= dates - 2 ORDER BY abs(running - total * 0.85::DOUBLE), cum.pos LIMIT 1)
    SELECT event_date, CASE WHEN event_date <= t.day THEN 'train' WHEN event_date <= v.day THEN 'validation' ELSE 'test' END AS split, COUNT(*) AS n
    FROM contests, t, v GROUP BY ALL""",
)
def fraction_split(spark, sf):
    return sp.split_by_fraction(fx.contests(spark, sf)).groupBy("event_date", "split").agg(F.count(F.lit(1)).alias("n"))


@query("p02_bounded_split", f"WITH {BOUNDED_SQL} SELECT contest_id, event_date, split FROM labelled")
def bounded_split(spark, sf):
    return sp.split_by_bounds(fx.contests(spark, sf), BOUNDS).select("contest_id", "event_date", "split")


SUMMARY_SQL = """SELECT split AS label, COUNT(*) AS row_count, COUNT(DISTINCT event_date) AS date_count,
    MIN(event_date) AS start_date, MAX(event_date) AS end_date FROM labelled GROUP BY split"""


@query("p03_split_summary", f"WITH {BOUNDED_SQL} {SUMMARY_SQL}")
def split_summary(spark, sf):
    return sp.split_summary(sp.split_by_bounds(fx.contests(spark, sf), BOUNDS))


def _loose(spark, sf):
    """Labels by year of day that overlap, to give the audit something to find."""
    priority = F.col("class")
    label = F.when(priority == "1-URGENT", "train").when(priority == "2-HIGH", "validation").when(priority == "3-MEDIUM", "test").when(priority == "5-LOW", "other")
    return fx.contests(spark, sf).withColumn("split", label)


LOOSE_SQL = f"""{fx.CONTESTS_SQL}, loose AS (SELECT *, CASE class WHEN '1-URGENT' THEN 'train' WHEN '2-HIGH' THEN 'validation'
    WHEN '3-MEDIUM' THEN 'test' WHEN '5-LOW' THEN 'other' END AS split FROM contests)"""


@query(
    "p03_split_audit",
    f"""WITH {LOOSE_SQL}, ends AS (SELECT split, MIN(event_date) AS s, MAX(event_date) AS e, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS pos
       FROM loose WHERE split IN ('train', 'validation', 'test') GROUP BY 1),
    ordered AS (SELECT *, lag(e) OVER (ORDER BY pos) AS pe FROM ends),
    shared AS (SELECT event_date FROM loose GROUP BY 1 HAVING COUNT(DISTINCT coalesce(split, '')) > 1)
    SELECT 'split_null' AS "check", 'split' AS "column", COUNT(DISTINCT event_date) FILTER (split IS NULL) AS bad_count FROM loose
    UNION ALL SELECT 'split_unknown', 'split', COUNT(DISTINCT event_date) FILTER (split = 'other') FROM loose
    UNION ALL SELECT 'split_empty', unnest(['train', 'validation', 'test']), unnest([COUNT(*) FILTER (split = 'train') = 0, COUNT(*) FILTER (split = 'validation') = 0, COUNT(*) FILTER (split = 'test') = 0])::BIGINT FROM loose
    UNION ALL SELECT 'date_in_several_splits', 'event_date', COUNT(*) FROM shared
    UNION ALL SELECT 'split_order', 'split', COUNT(*) FILTER (s <= pe) FROM ordered
    UNION ALL SELECT 'bad_date', 'event_date', CAST(0 AS BIGINT)""",
)
def split_audit(spark, sf):
    return _flat(sp.split_findings(_loose(spark, sf))).drop("examples")


@query(
    "p04_split_bounds",
    f"WITH {LOOSE_SQL} "
    + _count_sql(
        "split_bounds",
        {
            "train_after_maximum": f"split = 'train' AND event_date > DATE '{fx.TRAIN_END}'",
            "validation_before_minimum": f"split = 'validation' AND event_date < DATE '{fx.VALIDATION_START}'",
            "validation_after_maximum": f"split = 'validation' AND event_date > DATE '{fx.VALIDATION_END}'",
            "test_before_minimum": f"split = 'test' AND event_date < DATE '{fx.TEST_START}'",
            "test_after_maximum": f"split = 'test' AND event_date > DATE '{fx.CUTOFF}'",
        },
        "loose",
    ),
)
def split_bounds(spark, sf):
    return _flat(sp.bounds_findings(_loose(spark, sf), BOUNDS, date="event_date", split="split"))


@query(
    "p05_split_tables",
    f"""WITH {BOUNDED_SQL} SELECT split, COUNT(*) AS n, round(AVG(feature_price), 6) AS mean_price, CAST(SUM(target) AS BIGINT) AS positives FROM labelled GROUP BY 1""",
)
def split_tables(spark, sf):
    parts = sp.split_tables(sp.split_by_bounds(fx.contests(spark, sf), BOUNDS))
    summed = [
        part.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("feature_price")).alias("mean_price"), F.sum("target").alias("positives"))
        for part in parts
    ]
    return summed[0].unionByName(summed[1]).unionByName(summed[2])


@query(
    "p06_date_check",
    """WITH t AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'later' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) """
    + _count_sql("bad_date", {"d": "try_cast(d AS DATE) IS NULL"}, "t"),
)
def date_check(spark, sf):
    d = F.when(F.col("o_orderkey") % 9 == 0, "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _flat(sp.date_findings(table(spark, sf, "orders").select(d.alias("d")), "d"))
