"""Metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.functions.values import experience_band, pair_experience_band, probability_band
from duelframe.operators import metrics as m
from duelframe.operators import segments as s
from duelframe.registry import fixtures as fx
from duelframe.registry.base import as_bigint, query, r6, rounded, table

EPS = "2.220446049250313e-16"
CLIPPED = f"greatest({EPS}, least(1 - {EPS}, p))"
LOGLOSS = f"CASE WHEN y = 1 THEN -ln({CLIPPED}) ELSE -ln(1 - {CLIPPED}) END"
COUNTS = ("sample_count", "positive_count", "true_negative", "false_positive", "false_negative", "true_positive")


def _p2(df):
    return df.drop("p").withColumnRenamed("p2", "p")


@query(
    "e01_counts_prevalence",
    f"""WITH {fx.SCORED_SQL}
    SELECT COUNT(*) AS sample_count, CAST(SUM(y) AS BIGINT) AS positive_count, round(AVG(y), 6) AS prevalence
    FROM scored""",
)
def counts_prevalence(spark, sf):
    out = m.binary_metrics(fx.scored(spark, sf), ranking=False)
    return rounded(out.select("sample_count", "positive_count", "prevalence"), "prevalence")


@query("e02_log_loss", f"WITH {fx.SCORED_SQL} SELECT round(AVG({LOGLOSS}), 6) AS log_loss FROM scored")
def log_loss(spark, sf):
    return rounded(m.binary_metrics(fx.scored(spark, sf), ranking=False).select("log_loss"), "log_loss")


@query(
    "e03_brier_score",
    f"WITH {fx.SCORED_SQL} SELECT round(AVG((p2 - y) * (p2 - y)), 6) AS brier_score FROM scored",
)
def brier(spark, sf):
    out = m.binary_metrics(fx.scored(spark, sf), p="p2", ranking=False)
    return rounded(out.select("brier_score"), "brier_score")


def _rank_sql(p, by=""):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    per_score AS (SELECT {keys}{p} AS p, COUNT(*) AS n, SUM(y) AS pos FROM rows_in GROUP BY {keys}{p}),
    ranked AS (
      SELECT *, SUM(n) OVER ({part}ORDER BY p) - n AS n_below, SUM(pos) OVER ({part}ORDER BY p) - pos AS pos_below,
             SUM(n) OVER ({part.strip()}) AS total, SUM(pos) OVER ({part.strip()}) AS positives FROM per_score),
    ranking AS (
      SELECT {keys}
        CASE WHEN MAX(positives) > 0 AND MAX(positives) < MAX(total) THEN
          SUM(pos * ((n_below - pos_below) + (n - pos) / 2.0)) / (MAX(positives) * (MAX(total) - MAX(positives))) END AS roc_auc,
        CASE WHEN MAX(positives) > 0 AND MAX(positives) < MAX(total) THEN
          SUM(pos * (CAST(positives - pos_below AS DOUBLE) / (total - n_below))) / MAX(positives) END AS average_precision
      FROM ranked {group})"""


@query(
    "e04_roc_auc",
    f"""WITH {fx.SCORED_SQL}, rows_in AS (SELECT y, p2 FROM scored), {_rank_sql("p2")}
    SELECT round(CAST(roc_auc AS DOUBLE), 6) AS roc_auc FROM ranking""",
)
def roc_auc(spark, sf):
    return rounded(m.binary_metrics(fx.scored(spark, sf), p="p2").select("roc_auc"), "roc_auc")


NULL_GROUP_SQL = """raw AS (
      SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS g, CAST(o_orderstatus = 'F' AS INT) AS y, (o_custkey % 97) / 97.0::DOUBLE AS p
      FROM orders)"""


def _null_groups(spark, sf):
    orders = table(spark, sf, "orders")
    group = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    return orders.select(group.alias("g"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_custkey") % 97) / 97.0).alias("p"))


@query(
    "e04_auc_null_group",
    f"""WITH {NULL_GROUP_SQL},
    k AS (SELECT g, p, COUNT(*) AS n, SUM(y) AS pos FROM raw GROUP BY g, p),
    b AS (SELECT g, n, pos, COALESCE(SUM(n - pos) OVER (PARTITION BY g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k)
    SELECT g, CAST(SUM(n) AS BIGINT) AS sample_count, round(CAST(SUM(pos * (below + (n - pos) / 2.0)) / (SUM(pos) * (SUM(n) - SUM(pos))) AS DOUBLE), 6) AS roc_auc
    FROM b GROUP BY g""",
)
def auc_null_group(spark, sf):
    """A null group is a group of its own."""
    out = m.binary_metrics(_null_groups(spark, sf), by=["g"])
    return rounded(out.select("g", F.col("sample_count").cast("bigint").alias("sample_count"), "roc_auc"), "roc_auc")


@query(
    "e09_quantile_null_group",
    f"""WITH {NULL_GROUP_SQL},
    points AS (SELECT g, list_sort(list_distinct(quantile_cont(p, [i * (1.0::DOUBLE / 5) FOR i IN range(0, 5)] || [1.0::DOUBLE]))) AS e FROM raw GROUP BY g),
    edges AS (SELECT g, CASE WHEN len(e) < 3 THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [0.0::DOUBLE] || e[2:len(e)-1] || [1.0::DOUBLE] END AS e FROM points),
    binned AS (SELECT raw.g, y, p, list_count(list_filter(e[2:len(e)-1], lambda x: x <= p)) AS b FROM raw JOIN edges ON raw.g IS NOT DISTINCT FROM edges.g)
    SELECT g, CAST(b AS INT) AS bin_index, COUNT(*) AS count, round(AVG(y), 6) AS observed_rate FROM binned GROUP BY g, b""",
)
def quantile_null_group(spark, sf):
    out = m.reliability_bins(_null_groups(spark, sf), by=["g"], n_bins=5, strategy="quantile")
    return rounded(out.select("g", "bin_index", F.col("count").cast("bigint").alias("count"), "observed_rate"), "observed_rate")


@query(
    "e05_average_precision",
    f"""WITH {fx.SCORED_SQL}, rows_in AS (SELECT y, p FROM scored), {_rank_sql("p")}
    SELECT round(CAST(average_precision AS DOUBLE), 6) AS average_precision FROM ranking""",
)
def average_precision(spark, sf):
    out = m.binary_metrics(fx.scored(spark, sf)).select("average_precision")
    return rounded(out, "average_precision")


CONFUSION = """
    COUNT(*) FILTER (y = 0 AND p < 0.5) AS tn, COUNT(*) FILTER (y = 0 AND p >= 0.5) AS fp,
    COUNT(*) FILTER (y = 1 AND p < 0.5) AS fn, COUNT(*) FILTER (y = 1 AND p >= 0.5) AS tp"""


@query(
    "e06_threshold_rates",
    f"""WITH {fx.SCORED_SQL}, c AS (SELECT {CONFUSION} FROM scored)
    SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
           round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
           round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score FROM c""",
)
def threshold_rates(spark, sf):
    names = ("accuracy", "precision", "recall", "f1_score")
    return rounded(m.binary_metrics(fx.scored(spark, sf), ranking=False).select(*names), *names)


@query(
    "e07_confusion",
    f"""WITH {fx.SCORED_SQL}, c AS (SELECT {CONFUSION} FROM scored)
    SELECT tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive FROM c""",
)
def confusion(spark, sf):
    return m.binary_metrics(fx.scored(spark, sf), ranking=False).select(*COUNTS[2:])


UNIFORM_BIN = "least(9, list_count(list_filter([i * (1.0::DOUBLE / 10) FOR i IN range(1, 10)], lambda e: e <= p)))"
BIN_FIELDS = """COUNT(*) AS "count", round(AVG(p), 6) AS mean_probability, round(AVG(y), 6) AS observed_rate,
    round(abs(AVG(p) - AVG(y)), 6) AS absolute_gap"""


@query(
    "e08_uniform_bins",
    f"""WITH {fx.SCORED_SQL}
    SELECT CAST({UNIFORM_BIN} AS INT) AS bin_index, {BIN_FIELDS} FROM scored GROUP BY 1""",
)
def uniform_bins(spark, sf):
    out = m.reliability_bins(fx.scored(spark, sf)).drop("lower_bound", "upper_bound")
    return rounded(out, "mean_probability", "observed_rate", "absolute_gap")


QUANTILE_SQL = f"""
    points AS (SELECT list_sort(list_distinct(quantile_cont(p, [i * (1.0::DOUBLE / 10) FOR i IN range(0, 10)] || [1.0::DOUBLE]))) AS e FROM rows_in),
    edges AS (SELECT CASE WHEN len(e) < 3 THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [0.0::DOUBLE] || e[2:len(e)-1] || [1.0::DOUBLE] END AS e FROM points),
    binned AS (SELECT y, p, list_count(list_filter(e[2:len(e)-1], lambda x: x <= p)) AS b, e FROM rows_in, edges)"""


@query(
    "e09_quantile_bins",
    f"""WITH {fx.SCORED_SQL}, rows_in AS (SELECT y, p2 AS p FROM scored), {QUANTILE_SQL}
    SELECT CAST(b AS INT) AS bin_index, round(MIN(e[b + 1]), 6) AS lower_bound, round(MIN(e[b + 2]), 6) AS upper_bound,
           {BIN_FIELDS} FROM binned GROUP BY b""",
)
def quantile_bins(spark, sf):
    out = m.reliability_bins(fx.scored(spark, sf), p="p2", strategy="quantile")
    return rounded(out, "lower_bound", "upper_bound", "mean_probability", "observed_rate", "absolute_gap")


@query(
    "e09_quantile_edges_tied",
    f"""WITH {fx.SCORED_SQL}, rows_in AS (SELECT y, p FROM scored), {QUANTILE_SQL}
    SELECT CAST(generate_subscripts(e, 1) - 1 AS INT) AS edge_index, round(unnest(e), 6) AS edge FROM edges""",
)
def quantile_edges(spark, sf):
    out = m.quantile_edges(fx.scored(spark, sf))
    return out.select(F.posexplode("edges").alias("edge_index", "edge")).select("edge_index", r6("edge").alias("edge"))


@query(
    "e10_calibration_error",
    f"""WITH {fx.SCORED_SQL},
    b AS (SELECT {UNIFORM_BIN} AS i, COUNT(*) AS n, abs(AVG(p) - AVG(y)) AS gap FROM scored GROUP BY 1)
    SELECT round(SUM(n * gap) / SUM(n), 6) AS expected_calibration_error, round(MAX(gap), 6) AS maximum_calibration_error FROM b""",
)
def calibration_error(spark, sf):
    out = m.calibration_error(fx.scored(spark, sf))
    return rounded(out, "expected_calibration_error", "maximum_calibration_error")


def _subgroup_sql(segments: dict[str, str], source: str, p: str, min_samples: int) -> str:
    """Per-group metrics written out for the comparison engine."""
    long = " UNION ALL ".join(
        f"SELECT '{name}' AS segment, coalesce(CAST({expr} AS VARCHAR), '<missing>') AS value, y, {p} AS p FROM {source}"
        for name, expr in segments.items()
    )
    clipped = f"greatest({EPS}, least(1 - {EPS}, p))"
    return f"""
    rows_in AS ({long}),
    sizes AS (SELECT segment, value, COUNT(*) AS n_all, least(10, greatest(2, COUNT(*) // 10)) AS bins FROM rows_in GROUP BY ALL),
    point AS (SELECT segment, value, COUNT(*) AS sample_count, CAST(SUM(y) AS BIGINT) AS positive_count,
        AVG(CASE WHEN y = 1 THEN -ln({clipped}) ELSE -ln(1 - {clipped}) END) AS log_loss,
        AVG((p - y) * (p - y)) AS brier_score, AVG(CAST((p >= 0.5) = (y = 1) AS INT)) AS accuracy
        FROM rows_in GROUP BY ALL),
    bin_rows AS (SELECT segment, value, y, p,
        list_count(list_filter([i * (1.0::DOUBLE / bins) FOR i IN range(1, bins)], lambda e: e <= p)) AS b
        FROM rows_in JOIN sizes USING (segment, value)),
    bin_gaps AS (SELECT segment, value, b, COUNT(*) AS n, abs(AVG(p) - AVG(y)) AS gap FROM bin_rows GROUP BY ALL),
    ece AS (SELECT segment, value, SUM(n * gap) / SUM(n) AS ece, MAX(gap) AS mce FROM bin_gaps GROUP BY ALL),
    {_rank_sql("p", "segment, value")}
    SELECT segment, value, sample_count, positive_count,
        CASE WHEN sample_count < {min_samples} THEN 'Fewer than min_samples={min_samples} rows.' END AS skipped_reason,
        CASE WHEN sample_count >= {min_samples} THEN round(log_loss, 6) END AS log_loss,
        CASE WHEN sample_count >= {min_samples} THEN round(brier_score, 6) END AS brier_score,
        CASE WHEN sample_count >= {min_samples} THEN round(accuracy, 6) END AS accuracy,
        CASE WHEN sample_count >= {min_samples} THEN round(CAST(roc_auc AS DOUBLE), 6) END AS roc_auc,
        CASE WHEN sample_count >= {min_samples} THEN round(CAST(average_precision AS DOUBLE), 6) END AS average_precision,
        CASE WHEN sample_count >= {min_samples} THEN round(ece, 6) END AS expected_calibration_error,
        CASE WHEN sample_count >= {min_samples} THEN round(mce, 6) END AS maximum_calibration_error
    FROM point JOIN ece USING (segment, value) JOIN ranking USING (segment, value)"""


def _subgroup_columns(out):
    metrics = (
        "log_loss", "brier_score", "accuracy", "roc_auc", "average_precision",
        "expected_calibration_error", "maximum_calibration_error",
    )
    return rounded(
        out.select("segment", "value", "sample_count", "positive_count", "skipped_reason", *metrics), *metrics
    )


@query(
    "e11_subgroups",
    f"""WITH {fx.SCORED_CTX_SQL}, {_subgroup_sql({"ctx": "ctx", "flag": "flag", "title": "title"}, "scored_ctx", "p2", 50)}""",
)
def subgroups(spark, sf):
    return _subgroup_columns(s.subgroup_metrics(fx.scored_ctx(spark, sf), ["ctx", "flag", "title"], p="p2"))


@query(
    "e11_small_groups",
    f"""WITH {fx.SCORED_SQL}, {_subgroup_sql({"l_partkey": "l_partkey"}, "scored", "p", 30)}""",
)
def small_groups(spark, sf):
    out = s.subgroup_metrics(fx.scored(spark, sf), ["l_partkey"], min_samples=30)
    return _subgroup_columns(out)


EXPERIENCE = """CASE WHEN {x} = 0 THEN 'debut' WHEN {x} BETWEEN 1 AND 2 THEN '1_to_2' WHEN {x} BETWEEN 3 AND 5 THEN '3_to_5'
    WHEN {x} BETWEEN 6 AND 10 THEN '6_to_10' ELSE '11_plus' END"""
CONFIDENCE = """CASE WHEN greatest({p}, 1 - {p}) < 0.6 THEN '0.50_to_0.60' WHEN greatest({p}, 1 - {p}) < 0.7 THEN '0.60_to_0.70'
    WHEN greatest({p}, 1 - {p}) < 0.8 THEN '0.70_to_0.80' ELSE '0.80_plus' END"""


@query(
    "e12_experience_bands",
    f"""SELECT {EXPERIENCE.format(x="(l_quantity - 1)")} AS band, COUNT(*) AS n FROM lineitem GROUP BY 1""",
)
def experience_bands(spark, sf):
    band = experience_band(F.col("l_quantity") - 1).alias("band")
    return table(spark, sf, "lineitem").groupBy(band).agg(F.count(F.lit(1)).alias("n"))


@query(
    "e13_pair_experience_bands",
    f"""SELECT {EXPERIENCE.format(x="least(l_quantity - 1, l_linenumber - 1)")} AS band, COUNT(*) AS n FROM lineitem GROUP BY 1""",
)
def pair_bands(spark, sf):
    band = pair_experience_band(F.col("l_quantity") - 1, F.col("l_linenumber") - 1).alias("band")
    return table(spark, sf, "lineitem").groupBy(band).agg(F.count(F.lit(1)).alias("n"))


@query(
    "e14_probability_bands",
    f"""WITH {fx.SCORED_SQL} SELECT {CONFIDENCE.format(p="p2")} AS band, COUNT(*) AS n FROM scored GROUP BY 1""",
)
def probability_bands(spark, sf):
    return fx.scored(spark, sf).groupBy(probability_band("p2").alias("band")).agg(F.count(F.lit(1)).alias("n"))


SEVEN = {
    "division": "ctx",
    "both_fighters_have_ufc_history": "CASE WHEN prior >= 1 THEN 'yes' ELSE 'no' END",
    "at_least_one_ufc_debutant": "CASE WHEN prior = 0 THEN 'yes' ELSE 'no' END",
    "both_fighters_have_three_plus_fights": "CASE WHEN prior >= 3 THEN 'yes' ELSE 'no' END",
    "experience_band": EXPERIENCE.format(x="prior"),
    "probability_band": CONFIDENCE.format(p="p2"),
    "title_bout": "CASE WHEN title >= 0.5 THEN 'yes' ELSE 'no' END",
}


@query("e15_standard_segments", f"""WITH {fx.SCORED_CTX_SQL}, {_subgroup_sql(SEVEN, "scored_ctx", "p2", 50)}""")
def standard_segments(spark, sf):
    scored = fx.scored_ctx(spark, sf)
    framed, names = s.standard_segments(
        scored, "p2", context_class="ctx", min_history="prior", title=None
    )
    yes_no = F.when(F.col("title") >= 0.5, "yes").otherwise("no")
    framed = framed.withColumn("title_bout", yes_no)
    return _subgroup_columns(s.rename_segments(s.subgroup_metrics(framed, [*names, "title_bout"], p="p2")))


@query(
    "e16_full_report",
    f"""WITH {fx.SCORED_SQL}, rows_in AS (SELECT y, p2 AS p FROM scored),
    point AS (SELECT COUNT(*) AS sample_count, CAST(SUM(y) AS BIGINT) AS positive_count, AVG(y) AS prevalence,
       AVG({LOGLOSS}) AS log_loss, AVG((p - y) * (p - y)) AS brier_score, {CONFUSION} FROM rows_in),
    b AS (SELECT {UNIFORM_BIN} AS i, COUNT(*) AS n, abs(AVG(p) - AVG(y)) AS gap FROM rows_in GROUP BY 1),
    ece AS (SELECT SUM(n * gap) / SUM(n) AS e, MAX(gap) AS m FROM b), {_rank_sql("p")}
    SELECT 'fixture' AS model_name, 'all' AS split_name, sample_count, positive_count, round(prevalence, 6) AS prevalence,
       round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score,
       round(CAST(roc_auc AS DOUBLE), 6) AS roc_auc, round(CAST(average_precision AS DOUBLE), 6) AS average_precision,
       round((tp + tn) / sample_count, 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
       tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive, CAST(0.5 AS DOUBLE) AS threshold,
       round(e, 6) AS expected_calibration_error, round(m, 6) AS maximum_calibration_error
    FROM point, ece, ranking""",
)
def full_report(spark, sf):
    report = s.evaluation_report(fx.scored(spark, sf), model_name="fixture", split_name="all", p="p2")
    floats = [c for c in m.METRIC_COLUMNS if c not in (*COUNTS, "threshold")]
    return rounded(report["metrics"], *floats)


def _parts_of_report(spark, sf, **more):
    """The report over one read; three segments, persisted sums."""
    return s.evaluation_report(fx.scored_ctx(spark, sf), model_name="fixture", split_name="all", p="p2", segments=["ctx", "flag", "title"], **more)


NAMED = "'fixture' AS model_name, 'all' AS split_name"


@query(
    "e16_report_bins",
    f"""WITH {fx.SCORED_CTX_SQL}, b AS (SELECT {UNIFORM_BIN} AS i, y, p FROM (SELECT y, p2 AS p FROM scored_ctx))
    SELECT {NAMED}, CAST(i AS INT) AS bin_index, round(i * 0.1::DOUBLE, 6) AS lower_bound, round((i + 1) * 0.1::DOUBLE, 6) AS upper_bound, {BIN_FIELDS} FROM b GROUP BY i""",
)
def report_bins(spark, sf):
    out = _parts_of_report(spark, sf)["bins"]
    return rounded(as_bigint(out, "count"), "lower_bound", "upper_bound", "mean_probability", "observed_rate", "absolute_gap")


@query(
    "e16_report_subgroups",
    f"""SELECT {NAMED}, t.* FROM (WITH {fx.SCORED_CTX_SQL}, {_subgroup_sql({"ctx": "ctx", "flag": "flag", "title": "title"}, "scored_ctx", "p2", 50)}) t""",
)
def report_subgroups(spark, sf):
    out = _parts_of_report(spark, sf)["subgroups"]
    return _subgroup_columns(out).withColumns({"model_name": F.lit("fixture"), "split_name": F.lit("all")})


@query(
    "e16_report_notes",
    f"""WITH {fx.SCORED_CTX_SQL}
    SELECT {NAMED}, kind, name, text FROM (
      SELECT 'note' AS kind, '0' AS name, 'first' AS text UNION ALL SELECT 'note', '1', 'second' UNION ALL SELECT 'setting', 'bin_strategy', 'quantile' UNION ALL SELECT 'setting', 'n_bins', '7'
      UNION ALL SELECT 'metadata', 'rows', CAST(COUNT(*) AS VARCHAR) FROM scored_ctx UNION ALL SELECT 'metadata', 'last_date', CAST(MAX(event_date) AS VARCHAR) FROM scored_ctx)""",
)
def report_notes(spark, sf):
    known = fx.scored_ctx(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.max("event_date").cast("string").alias("last_date")).first().asDict()
    return _parts_of_report(spark, sf, notes=("first", "second"), metadata=known, n_bins=7, strategy="quantile")["notes"]


@query(
    "q21_prediction_check",
    f"""WITH {fx.SCORED_SQL}, shifted AS (SELECT y + CAST(l_linenumber = 7 AS INT) AS y, CASE WHEN l_linenumber = 6 THEN 'NaN'::DOUBLE ELSE p2 * 1.2 END AS p FROM scored)
    SELECT COUNT(*) AS row_count, COUNT(*) FILTER (y NOT IN (0, 1)) AS bad_target,
      COUNT(*) FILTER (NOT isfinite(p)) AS non_finite_probability,
      COUNT(*) FILTER (isfinite(p) AND (p < 0 OR p > 1)) AS outside_unit_interval FROM shifted""",
)
def prediction_check(spark, sf):
    line = F.col("l_linenumber")
    bad = fx.scored(spark, sf).select(
        (F.col("y") + (line == 7).cast("int")).alias("y"),
        F.when(line == 6, F.lit(float("nan"))).otherwise(F.col("p2") * 1.2).alias("p"),
    )
    return as_bigint(m.prediction_findings(bad), "row_count")
