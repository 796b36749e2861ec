"""Tables of the operators' input shapes, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.registry.base import table

# A scored table: y is the outcome, p has heavy ties, p2 has almost none.
SCORED_SQL = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         CAST(l_returnflag = 'R' AS INT) AS y,
         (l_quantity - 0.5) / 50 AS p,
         l_extendedprice / (l_extendedprice + 50000) AS p2,
         CAST(l_linenumber - 1 AS DOUBLE) AS prior,
         CAST(l_linenumber = 1 AS INT) AS title,
         l_returnflag AS flag,
         CAST(l_shipdate AS DATE) AS event_date
  FROM lineitem)
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_quantity") - 0.5) / 50).alias("p"),
        (price / (price + 50000)).alias("p2"),
        (F.col("l_linenumber") - 1).cast("double").alias("prior"),
        (F.col("l_linenumber") == 1).cast("int").alias("title"),
        F.col("l_returnflag").alias("flag"),
        F.to_date("l_shipdate").alias("event_date"),
    )


SCORED_CTX_SQL = (
    SCORED_SQL
    + """,
scored_ctx AS (SELECT s.*, o_orderpriority AS ctx FROM scored s JOIN orders ON l_orderkey = o_orderkey)
"""
)


def scored_ctx(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ctx"))
    return scored(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


# A contest table with a binary target, two entities and a date.
CONTESTS_SQL = """
contests AS (
  SELECT o_orderkey AS contest_id,
         CAST(o_orderdate AS DATE) AS event_date,
         o_custkey AS a_id,
         (o_custkey * 7 + o_orderkey) % (SELECT COUNT(*) FROM customer) AS b_id,
         CAST(o_orderstatus = 'F' AS INT) AS target,
         o_orderpriority AS class,
         o_totalprice AS feature_price,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS feature_priority
  FROM orders)
"""


def contests(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").count()
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("contest_id"),
        F.to_date("o_orderdate").alias("event_date"),
        F.col("o_custkey").alias("a_id"),
        ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % customers).alias("b_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.col("o_orderpriority").alias("class"),
        F.col("o_totalprice").alias("feature_price"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("feature_priority"),
    )


TRAIN_END, VALIDATION_START, VALIDATION_END, TEST_START, CUTOFF = (
    "1999-12-31", "2000-01-01", "2000-12-31", "2001-01-01", "2010-12-31",
)

# Entity snapshots: state of every user at the end of every active day.
SNAPSHOTS_SQL = """
daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, SUM(value) AS v,
         COUNT(*) FILTER (event_type = 'error') AS errors
  FROM events GROUP BY ALL),
snaps AS (
  SELECT user_id AS entity_id,
         day AS as_of,
         LAG(day) OVER (PARTITION BY user_id ORDER BY day) AS last_event,
         CASE WHEN user_id % 4 <> 0 THEN DATE '1980-01-01' + CAST(30 * (user_id % 500) AS INT) END AS dob,
         CAST(SUM(n) OVER (PARTITION BY user_id ORDER BY day) - n AS DOUBLE) AS feature_prior_fights,
         SUM(v) OVER (PARTITION BY user_id ORDER BY day) AS feature_career_minutes,
         CAST(SUM(errors) OVER (PARTITION BY user_id ORDER BY day) AS DOUBLE) AS feature_errors,
         CAST(n AS DOUBLE) AS feature_activity_365d,
         CAST(n + 1 AS DOUBLE) AS feature_activity_730d
  FROM daily)
"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    daily = (
        table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("value").alias("v"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
        )
    )
    # one row per user and calendar day, so a partition holds at most one row per day
    by_day = Window.partitionBy("user_id").orderBy("day")
    running = by_day.rowsBetween(Window.unboundedPreceding, 0)
    birth = F.date_add(F.lit("1980-01-01").cast("date"), (30 * (F.col("user_id") % 500)).cast("int"))
    return daily.select(
        F.col("user_id").alias("entity_id"),
        F.col("day").alias("as_of"),
        F.lag("day").over(by_day).alias("last_event"),
        F.when(F.col("user_id") % 4 != 0, birth).alias("dob"),
        (F.sum("n").over(running) - F.col("n")).cast("double").alias("feature_prior_fights"),
        F.sum("v").over(running).alias("feature_career_minutes"),
        F.sum("errors").over(running).cast("double").alias("feature_errors"),
        F.col("n").cast("double").alias("feature_activity_365d"),
        (F.col("n") + 1).cast("double").alias("feature_activity_730d"),
    )


# Requests: every event asks for its user against another one on that day.
REQUESTS_SQL = """
users AS (SELECT MAX(user_id) + 1 AS n FROM events),
requests AS (
  SELECT event_id AS request_id, user_id AS a_id, (user_id + event_id) % (SELECT n FROM users) AS b_id,
         CAST(ts AS DATE) AS ref_date
  FROM events)
"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    users = events.agg(F.max("user_id") + 1).first()[0]
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("a_id"),
        ((F.col("user_id") + F.col("event_id")) % users).alias("b_id"),
        F.to_date("ts").alias("ref_date"),
    )
