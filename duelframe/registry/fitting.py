"""Fits, calibration and selection on derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.operators import calibration as k
from duelframe.operators import models as m
from duelframe.operators import isotonic, selection, segments
from duelframe.operators.metrics import binary_metrics
from duelframe.operators.scorers import positive_probability
from duelframe.registry import fixtures as fx
from duelframe.registry.base import as_bigint, query, r6, rounded, table

NAMES = ["l_discount", "l_tax", "l_quantity"]
SPLIT_DAY = fx.TRAIN_END


def labelled(spark, sf):
    """Numeric features with a target; the last feature carries some signal."""
    line = table(spark, sf, "lineitem")
    noise = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(1000)) / 1000.0
    target = (noise < 0.2 + F.col("l_quantity") / 100 + F.col("l_discount")).cast("int")
    return line.select(*NAMES, target.alias("y"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag"))


def _parts(spark, sf):
    rows = labelled(spark, sf)
    end = F.lit(SPLIT_DAY).cast("date")
    return rows.where(F.col("day") <= end), rows.where(F.col("day") > end)


@query(
    "m01_standardise",
    """SELECT unnest(['l_discount', 'l_tax', 'l_quantity', 'l_constant']) AS feature, round(unnest([AVG(l_discount), AVG(l_tax), AVG(l_quantity), 3.0]), 6) AS mean,
    round(unnest([stddev_pop(l_discount), stddev_pop(l_tax), stddev_pop(l_quantity), 1.0]), 6) AS scale FROM lineitem""",
)
def standardise(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_constant", F.lit(3.0))
    return rounded(m.moments(rows, [*NAMES, "l_constant"]), "mean", "scale")


def _fitted(spark, sf, candidate):
    train, validation = _parts(spark, sf)
    fit = m.fit_logistic(train, NAMES, "y", candidate)
    scored = positive_probability(fit.model, validation, "p")
    return rounded(binary_metrics(scored, ranking=False).select("sample_count", "positive_count", "log_loss", "brier_score"), "log_loss", "brier_score")


@query("m02_logistic_l2")
def logistic_l2(spark, sf):
    return _fitted(spark, sf, m.LogisticCandidate("l2", "l2", 1.0))


@query("m03_logistic_elastic_net")
def logistic_elastic(spark, sf):
    return _fitted(spark, sf, m.LogisticCandidate("en", "elasticnet", 0.1, 0.5))


@query("m04_balanced_weights")
def balanced(spark, sf):
    return _fitted(spark, sf, m.LogisticCandidate("balanced", "l2", 1.0, balanced=True))


@query("m06_logistic_search")
def logistic_search(spark, sf):
    train, validation = _parts(spark, sf)
    return m.search_logistic(train, validation, NAMES, "y", m.logistic_grid((0.03, 1.0), (0.5,))).table(spark)


COEF = [0.4, -0.25, 0.9]


@query(
    "m07_coefficient_table",
    f"""WITH s AS (SELECT unnest(['l_discount', 'l_tax', 'l_quantity']) AS feature, unnest({COEF}) AS w, unnest([stddev_pop(l_discount), stddev_pop(l_tax), stddev_pop(l_quantity)]) AS scale FROM lineitem)
    SELECT feature, CAST(w AS DOUBLE) AS standardized_coefficient, round(w / scale, 6) AS raw_unit_coefficient, round(exp(w), 6) AS odds_ratio_per_standard_deviation FROM s""",
)
def coefficients(spark, sf):
    out = m.coefficient_table(spark, COEF, m.moments(table(spark, sf, "lineitem"), NAMES), NAMES).drop("position", "mean")
    return rounded(out, "raw_unit_coefficient", "odds_ratio_per_standard_deviation")


@query(
    "m08_raw_intercept",
    f"""SELECT round(0.7 - ({COEF[0]} / stddev_pop(l_discount) * AVG(l_discount) + {COEF[1]} / stddev_pop(l_tax) * AVG(l_tax) + {COEF[2]} / stddev_pop(l_quantity) * AVG(l_quantity)), 6) AS raw_intercept FROM lineitem""",
)
def intercept(spark, sf):
    out = m.coefficient_table(spark, COEF, m.moments(table(spark, sf, "lineitem"), NAMES), NAMES)
    return rounded(m.raw_intercept(out, 0.7), "raw_intercept")


SMALL_TREE = m.TreeCandidate("small", 3, 0.2, rounds=6, max_bin=32)


@query("m09_boosted_trees")
def trees(spark, sf):
    train, validation = _parts(spark, sf)
    fit = m.fit_trees(train, validation, NAMES, "y", SMALL_TREE)
    scored = positive_probability(fit.model, validation, "p")
    return rounded(binary_metrics(scored, ranking=False).select("sample_count", "log_loss"), "log_loss")


@query("m10_tree_search")
def tree_search(spark, sf):
    train, validation = _parts(spark, sf)
    candidates = [SMALL_TREE, m.TreeCandidate("shallow", 2, 0.2, rounds=4, max_bin=32)]
    return m.search_trees(train, validation, NAMES, "y", candidates).table(spark)


@query("m11_random_tuning")
def tuning(spark, sf):
    train, validation = _parts(spark, sf)
    space = m.TreeSpace(max_depth=(2, 3), rounds=(2, 5), max_bin=(32, 64))
    return m.tune_trees(train, validation, NAMES, "y", trials=2, space=space).table(spark)


@query("m14_importances")
def importances(spark, sf):
    train, validation = _parts(spark, sf)
    return m.importance_table(spark, m.fit_trees(train, validation, NAMES, "y", SMALL_TREE).model, NAMES)


LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))"
AFTER = f"(1 / (1 + exp(-(0.8 * {LOGIT} - 0.3))))"
SIGMOID = k.Sigmoid(0.8, -0.3)


@query("k01_identity_calibration", f"WITH {fx.SCORED_SQL} SELECT l_orderkey, l_linenumber, round(p, 6) AS p FROM scored")
def identity(spark, sf):
    return fx.scored(spark, sf).select("l_orderkey", "l_linenumber", r6(k.apply_calibration(k.Identity(), F.col("p"))).alias("p"))


@query("k02_sigmoid_apply", f"WITH {fx.SCORED_SQL} SELECT l_orderkey, l_linenumber, round({AFTER}, 6) AS p FROM scored")
def sigmoid_apply(spark, sf):
    return fx.scored(spark, sf).select("l_orderkey", "l_linenumber", r6(k.apply_calibration(SIGMOID, F.col("p"))).alias("p"))


@query("k02_sigmoid_fit")
def sigmoid_fit(spark, sf):
    rows = fx.scored(spark, sf)
    fit = k.fit_calibrator(rows, "y", "p")
    return rounded(k.calibration_summary(rows, fit.calibrator), "log_loss_before", "log_loss_after", "brier_before", "brier_after")


MINIMAX_SQL = f"""WITH {fx.SCORED_SQL},
    d AS (SELECT p, COUNT(*) AS n, SUM(y) AS s, row_number() OVER (ORDER BY p) AS i FROM scored GROUP BY p),
    c AS (SELECT *, SUM(n) OVER (ORDER BY i) AS cn, SUM(s) OVER (ORDER BY i) AS cs FROM d),
    r AS (SELECT a.i AS a, b.i AS b, CAST(b.cs - a.cs + a.s AS DOUBLE) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
    m AS (SELECT c.i, r.a, MIN(r.mean) AS least FROM c JOIN r ON r.a <= c.i AND r.b >= c.i GROUP BY 1, 2),
    g AS (SELECT c.p, c.n, c.i, v FROM c JOIN (SELECT i, MAX(least) AS v FROM m GROUP BY i) USING (i))"""


@query(
    "k03_isotonic_steps",
    f"""{MINIMAX_SQL}
    SELECT MIN(p) AS lower, MAX(p) AS upper, round(v, 6) AS value, CAST(SUM(n) AS BIGINT) AS weight FROM g GROUP BY v""",
)
def isotonic_steps(spark, sf):
    """Steps pooled in ranges and merged, against the minimax form of the fit."""
    return rounded(isotonic.fit_isotonic(fx.scored(spark, sf), buckets=8), "value")


@query("k03_isotonic_apply", f"{MINIMAX_SQL} SELECT p, round(v, 6) AS calibrated FROM g")
def isotonic_apply(spark, sf):
    scored = fx.scored(spark, sf)
    out = isotonic.apply_isotonic(scored.select("p").distinct(), isotonic.fit_isotonic(scored))
    return rounded(out, "calibrated")


@query("k03_isotonic_fit")
def isotonic_fit(spark, sf):
    rows = labelled(spark, sf).withColumn("p", F.col("l_quantity") / 60)
    fit = k.fit_calibrator(rows, "y", "p", method="isotonic")
    return rows.select("p", k.apply_calibration(fit.calibrator, F.col("p")).alias("calibrated")).distinct()


@query(
    "k04_calibration_summary",
    f"""WITH {fx.SCORED_SQL}, t AS (SELECT y, p, {AFTER} AS q FROM scored)
    SELECT COUNT(*) AS sample_count, CAST(SUM(y) AS BIGINT) AS positive_count, round(AVG(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss_before,
      round(AVG(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss_after, round(AVG((p - y) * (p - y)), 6) AS brier_before, round(AVG((q - y) * (q - y)), 6) AS brier_after FROM t""",
)
def summary(spark, sf):
    out = k.calibration_summary(fx.scored(spark, sf), SIGMOID)
    return rounded(as_bigint(out, "sample_count"), "log_loss_before", "log_loss_after", "brier_before", "brier_after")


@query(
    "k05_apply_clipped",
    f"WITH {fx.SCORED_SQL} SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 1.5 * p - 0.2)), 6) AS p FROM scored",
)
def clipped(spark, sf):
    return fx.scored(spark, sf).select("l_orderkey", "l_linenumber", r6(k.apply_calibration(lambda p: 1.5 * p - 0.2, F.col("p"))).alias("p"))


@query(
    "k06_calibrated_classifier",
    f"""WITH {fx.SCORED_SQL}, t AS (SELECT l_orderkey, l_linenumber, {AFTER} AS q FROM scored)
    SELECT l_orderkey, l_linenumber, round(q, 6) AS probability_1, round(1 - q, 6) AS probability_0, CAST(q >= 0.4 AS INT) AS label FROM t""",
)
def classifier(spark, sf):
    out = k.calibrated_classifier(fx.scored(spark, sf), SIGMOID, threshold=0.4)
    return rounded(out.select("l_orderkey", "l_linenumber", "probability_0", "probability_1", "label"), "probability_0", "probability_1")


# candidates: the score columns p and p2 stand for two fitted models
CANDIDATE_SQL = f"""{fx.SCORED_SQL}, long AS (SELECT 'trees:a' AS model_name, flag, title, y, p2 * 0.3 + 0.2 AS p FROM scored UNION ALL SELECT 'logistic:b', flag, title, y, p FROM scored),
sub AS (SELECT model_name, segment, value, AVG(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss FROM
  (SELECT model_name, 'flag' AS segment, flag AS value, y, p FROM long UNION ALL SELECT model_name, 'probability_band', CAST(title AS VARCHAR), y, p FROM long) GROUP BY ALL)"""


def _candidates(spark, sf):
    rows = fx.scored(spark, sf)
    trees = rows.withColumn("p", F.col("p2") * 0.3 + 0.2)
    return {"trees:a": trees, "logistic:b": rows}


def _subgroups(spark, sf):
    parts = []
    for name, rows in _candidates(spark, sf).items():
        framed = rows.withColumn("probability_band", F.col("title").cast("string"))
        parts.append(segments.subgroup_metrics(framed, ["flag", "probability_band"]).select(F.lit(name).alias("model_name"), "segment", "value", "log_loss"))
    return parts[0].unionByName(parts[1])


@query(
    "k07_select_model",
    f"""WITH {CANDIDATE_SQL}, o AS (SELECT model_name, AVG(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS ll FROM long GROUP BY 1),
    x AS (SELECT (SELECT ll FROM o WHERE model_name = 'trees:a') AS t, (SELECT ll FROM o WHERE model_name = 'logistic:b') AS l,
      (SELECT MAX(a.log_loss - b.log_loss) FROM sub a JOIN sub b USING (segment, value) WHERE a.model_name = 'trees:a' AND b.model_name = 'logistic:b' AND segment <> 'probability_band') AS r)
    SELECT CASE WHEN t < l THEN 'trees:a' ELSE 'logistic:b' END AS leader, CASE WHEN t < l - 0.005 AND r <= 0.02 THEN 'trees:a' ELSE 'logistic:b' END AS selected FROM x""",
)
def select_model(spark, sf):
    parts = []
    for name, rows in _candidates(spark, sf).items():
        one = binary_metrics(rows, ranking=False)
        parts.append(one.select(F.lit(name).alias("name"), F.lit(name.split(":")[0]).alias("family"), "log_loss", F.lit(None).cast("double").alias("calibration_error")))
    decision = selection.select_model(parts[0].unionByName(parts[1]), _subgroups(spark, sf))
    return spark.createDataFrame([(decision["leader"], decision["selected"])], "leader string, selected string")


@query(
    "k08_subgroup_guardrail",
    f"""WITH {CANDIDATE_SQL} SELECT round(MAX(a.log_loss - b.log_loss), 6) AS largest_regression FROM sub a JOIN sub b USING (segment, value)
    WHERE a.model_name = 'trees:a' AND b.model_name = 'logistic:b' AND segment <> 'probability_band'""",
)
def guardrail(spark, sf):
    return rounded(selection.largest_regression(_subgroups(spark, sf), "trees:a", "logistic:b"), "largest_regression")


@query("k09_ablation")
def ablation(spark, sf):
    train, validation = _parts(spark, sf)
    candidate = m.LogisticCandidate("l2", "l2", 1.0)

    def evaluate(kept):
        return m.validation_losses([m.fit_logistic(train, kept, "y", candidate).model], validation, "y")[0]

    return selection.feature_ablation(spark, NAMES, {"price": ["l_discount", "l_tax"], "amount": ["l_quantity"]}, evaluate)[1]
