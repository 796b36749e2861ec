"""Metrics: literal edges, properties and agreement of the two paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.operators import metrics as m
from duelframe.operators import segments as s


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def brute(rows):
    """Straight definitions over a small list."""
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        above = [(y, p) for y, p in rows if p >= t]
        hits = sum(y for y, _ in above)
        ap += sum(1 for y, p in rows if p == t and y == 1) / len(pos) * hits / len(above)
    eps = 2.220446049250313e-16
    ll = np.mean([-math.log(min(max(p if y else 1 - p, eps), 1)) for y, p in rows])
    return auc, ap, ll


@pytest.mark.parametrize("seed", range(3))
def test_ranking_matches_definition(spark, seed):
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.4), round(rng.random(), rng.choice([1, 2, 6]))) for _ in range(200)]
    got = m.binary_metrics(frame(spark, rows), buckets=7).first()
    auc, ap, ll = brute(rows)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert got["average_precision"] == pytest.approx(ap, abs=1e-12)
    assert got["log_loss"] == pytest.approx(ll, abs=1e-9)


@pytest.mark.parametrize("buckets", [1, 2, 5, 64])
def test_result_does_not_depend_on_ranges(spark, buckets):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.3), rng.choice([0.0, 1.0, rng.random(), 0.001])) for _ in range(300)]
    base = m.binary_metrics(frame(spark, rows), buckets=3).first().asDict()
    other = m.binary_metrics(frame(spark, rows), buckets=buckets).first().asDict()
    for key, value in base.items():
        assert other[key] == pytest.approx(value, abs=1e-12), key


def test_light_path_agrees_with_ranking_path(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.5), rng.random()) for _ in range(150)]
    light = m.binary_metrics(frame(spark, rows), ranking=False).first()
    full = m.binary_metrics(frame(spark, rows)).first()
    for key in m.METRIC_COLUMNS:
        if key not in ("roc_auc", "average_precision"):
            assert light[key] == pytest.approx(full[key], abs=1e-12), key


@pytest.mark.parametrize("n", [2, 3, 7, 10, 49, 100])
def test_uniform_bins_match_edge_counting(spark, n):
    edges = np.linspace(0.0, 1.0, n + 1)
    values = sorted({0.0, 1.0, *map(float, edges), *[float(np.nextafter(e, 0)) for e in edges[1:]], *[i / 97 for i in range(98)]})
    want = np.digitize(values, edges[1:-1])
    df = spark.createDataFrame([(v,) for v in values], "p double").select("p", m.uniform_bin(F.col("p"), n).alias("b"))
    got = {r["p"]: r["b"] for r in df.collect()}
    assert [got[v] for v in values] == list(want)


@pytest.mark.parametrize("rows", [
    [0.1, 0.2, 0.2, 0.2, 0.9], [0.5] * 8, [0.0, 1.0], [i / 37 for i in range(38)], [0.3, 0.3, 0.7],
])
def test_quantile_edges_match_linear_interpolation(spark, rows):
    edges = np.unique(np.quantile(rows, np.linspace(0, 1, 11)))
    want = [0.0, 1.0] if edges.size < 2 else [0.0, *edges[1:-1], 1.0]
    df = spark.createDataFrame([(float(v),) for v in rows], "p double")
    got = m.quantile_edges(df, buckets=3).first()["edges"]
    assert got == pytest.approx(want, abs=1e-12)


def test_single_class_has_no_ranking(spark):
    got = m.binary_metrics(frame(spark, [(1, 0.2), (1, 0.9)])).first()
    assert got["roc_auc"] is None and got["average_precision"] is None
    assert got["recall"] == 0.5 and got["true_negative"] == 0


def test_extreme_scores_stay_finite(spark):
    got = m.binary_metrics(frame(spark, [(1, 0.0), (0, 1.0), (1, 1.0), (0, 0.0)])).first()
    assert math.isfinite(got["log_loss"]) and got["brier_score"] == 0.5
    assert got["roc_auc"] == 0.5


def test_threshold_is_inclusive(spark):
    got = m.binary_metrics(frame(spark, [(1, 0.5), (0, 0.4999)]), ranking=False).first()
    assert (got["true_positive"], got["true_negative"]) == (1, 1)


def test_properties(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.5), rng.random()) for _ in range(120)]
    df = frame(spark, rows)
    a = m.binary_metrics(df).first()
    b = m.binary_metrics(df.withColumn("p", 1 - F.col("p"))).first()
    assert a["roc_auc"] == pytest.approx(1 - b["roc_auc"], abs=1e-12)
    assert a["expected_calibration_error"] <= a["maximum_calibration_error"]
    assert sum(r["count"] for r in m.reliability_bins(df, strategy="quantile").collect()) == 120


@pytest.mark.parametrize("rows, message", [
    ([(2, 0.5)], "only 0 and 1"), ([(1, float("nan"))], "finite"), ([(1, 1.5)], r"\[0, 1\]"), ([], "empty"),
])
def test_bad_predictions(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        m.assert_predictions(frame(spark, rows))


def test_subgroup_size_boundary(spark):
    rows = [(i % 2, 0.3, "a") for i in range(49)] + [(i % 2, 0.6, "b") for i in range(50)] + [(1, 0.6, None)]
    df = spark.createDataFrame(rows, "y int, p double, g string")
    out = {r["value"]: r for r in s.subgroup_metrics(df, ["g"]).collect()}
    assert out["a"]["skipped_reason"] and out["a"]["log_loss"] is None and out["a"]["sample_count"] == 49
    assert out["b"]["skipped_reason"] is None and out["b"]["log_loss"] is not None
    assert out["<missing>"]["sample_count"] == 1
    assert s.subgroup_metrics(df, ["g"], include_small=False).count() == 1
    with pytest.raises(ValueError):
        s.subgroup_metrics(df, ["g"], min_samples=101)


def test_one_segment_holding_most_rows(spark):
    """A group with nearly all rows gives the same numbers as the whole table."""
    df = spark.range(4000).select(
        (F.rand(1) < 0.4).cast("int").alias("y"), F.rand(2).alias("p"), F.when(F.col("id") < 3990, "hot").otherwise("cold").alias("g")
    ).persist()
    hot = s.subgroup_metrics(df, ["g"], min_samples=1, buckets=16).where("value = 'hot'").first()
    alone = m.binary_metrics(df.where("g = 'hot'"), buckets=5).first()
    assert hot["roc_auc"] == pytest.approx(alone["roc_auc"], abs=1e-12)
    assert hot["expected_calibration_error"] == pytest.approx(alone["expected_calibration_error"], abs=1e-12)


def test_null_groups_are_groups(spark):
    from duelframe.operators.metrics import binary_metrics, quantile_edges, reliability_bins

    rows = [(g, i % 2, (i % 10) / 10) for i in range(60) for g in ("a", "b", None)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    ranked = {r["g"]: (r["sample_count"], r["roc_auc"]) for r in binary_metrics(df, by=["g"]).collect()}
    assert set(ranked) == {"a", "b", None} and len(set(ranked.values())) == 1
    bins = reliability_bins(df, by=["g"], strategy="quantile", n_bins=4).groupBy("g").count().collect()
    assert {r["g"] for r in bins} == {"a", "b", None} and len({r["count"] for r in bins}) == 1
    assert {r["g"] for r in quantile_edges(df, by=["g"]).collect()} == {"a", "b", None}


def test_ranges_are_data_not_plan(spark):
    """Thousands of score ranges give the same numbers as one, and a plan of the same size."""
    df = spark.range(30_000).select((F.xxhash64("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("p")).persist()
    results, sizes = [], []
    for buckets in (1, 50, 5_000):
        out = m.binary_metrics(df, buckets=buckets)
        results.append(out.first().asDict())
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    for other in results[1:]:
        assert other == pytest.approx(results[0], abs=1e-12)
    assert sizes[2] <= sizes[1] * 1.1
    edges, _ = m.range_edges(df.groupBy(F.col("p").alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.sum("y").alias("__pos")), buckets=5_000)
    assert len(spark.range(1).select(edges.alias("e")).first()["e"]) > 4_000


def counted_source(spark, rows):
    """A table that counts how often its rows are read."""
    reads = spark.sparkContext.accumulator(0)

    def through(frames):
        for pdf in frames:
            reads.add(len(pdf))
            yield pdf

    return rows.mapInPandas(through, rows.schema), reads


def test_segments_and_report_read_the_table_once(spark):
    rows = spark.range(3_000).select((F.col("id") % 2).cast("int").alias("y"), F.rand(5).alias("p"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 5).cast("string").alias("h"))
    df, reads = counted_source(spark, rows)
    assert len(s.subgroup_metrics(df, ["g", "h"], check_size=False).collect()) == 8
    assert reads.value == 3_000
    df, reads = counted_source(spark, rows)
    report = s.evaluation_report(df, model_name="m", split_name="t", segments=["g", "h"])
    assert report["metrics"].first()["sample_count"] == 3_000
    assert report["bins"].agg(F.sum("count")).first()[0] == 3_000 and report["subgroups"].count() == 8
    assert reads.value == 3_000
    report["sums"].unpersist()


def test_quantile_bins_read_the_table_once(spark):
    rows = spark.range(3_000).select((F.col("id") % 2).cast("int").alias("y"), F.rand(5).alias("p"), (F.col("id") % 3).cast("string").alias("g"))
    df, reads = counted_source(spark, rows)
    report = s.evaluation_report(df, model_name="m", split_name="t", segments=["g"], n_bins=7, strategy="quantile")
    assert report["bins"].count() == 7 and report["subgroups"].count() == 3
    assert reads.value == 3_000
    report["sums"].unpersist()
    df, reads = counted_source(spark, rows)
    assert len(m.reliability_bins(df, n_bins=7, strategy="quantile").collect()) == 7
    assert reads.value == 3_000


@pytest.mark.parametrize("rows, message", [([(2, 0.5)] * 60, "only 0 and 1"), ([(1, float("nan"))] * 60, "finite"), ([(1, 1.5)] * 60, r"\[0, 1\]"), ([], "empty"), ([(1, 0.5)] * 5, "min_samples")])
def test_reports_refuse_bad_rows(spark, rows, message):
    df = frame(spark, rows).withColumn("g", F.lit("a"))
    with pytest.raises(ValueError, match=message):
        s.evaluation_report(df, model_name="m", split_name="t", segments=["g"])


def segmented(spark, n=400):
    rng = random.Random(17)
    rows = [(int(rng.random() < 0.4), rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]), rng.choice(["x", "y", None]), rng.choice([1.0, 2.0, float("nan")])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "y int, p double, a string, b double")


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_several_segments_match_definition_with_ties(spark, buckets):
    rows, df = segmented(spark)
    got = {(r["segment"], r["value"]): r for r in s.subgroup_metrics(df, ["a", "b"], min_samples=2, buckets=buckets).collect()}
    shown = lambda v: "<missing>" if v is None or v != v else str(v)
    wanted = {("a", shown(r[2])) for r in rows} | {("b", shown(r[3])) for r in rows}
    assert set(got) == wanted
    for segment, value in wanted:
        part = [(r[0], r[1]) for r in rows if shown(r[2] if segment == "a" else r[3]) == value]
        auc, ap, ll = brute(part)
        row = got[segment, value]
        assert row["sample_count"] == len(part)
        assert row["roc_auc"] == pytest.approx(auc, abs=1e-12)
        assert row["average_precision"] == pytest.approx(ap, abs=1e-12)
        assert row["log_loss"] == pytest.approx(ll, abs=1e-9)


def test_rows_are_dealt_before_they_are_multiplied_by_segments(spark):
    _, df = segmented(spark)
    plan = s.segment_bins(df, ["a", "b"], whole=True)._jdf.queryExecution().toString()
    assert "hashpartitioning(__group" not in plan


def test_score_ranges_are_compiled_and_sorted_by_few_keys(spark, capsys):
    """Rows find their range without interpreted folds, and those multiplied by segments are sorted by range and segment, value and score."""
    rows = [(f"v{i % 5}", f"w{i % 3}", i % 2, (i % 97) / 97.0) for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b string, y int, p double")
    m.with_range(df.withColumnRenamed("p", "__p"), (F.array(F.lit(0.25), F.lit(0.5)), 8)).explain()
    s.segment_bins(df, ["a", "b"], buckets=8).explain()
    ranges, plan = capsys.readouterr().out.split("== Physical Plan ==")[1:]
    assert "lambdafunction" not in ranges
    sorts = [line.split("],")[0] for line in plan.splitlines() if "Sort [__cell" in line]
    assert sorts and all(line.count(" ASC ") + line.count(" DESC ") == 4 for line in sorts)


def test_range_of_every_score(spark):
    """The number of boundaries at or below a score, also at, below and beyond the ends and for null and NaN."""
    edges = [0.1, 0.2, 0.2000001, 0.5, 0.9]
    scores = [0.0, 0.1, 0.15, 0.2, 0.2000001, 0.4, 0.5, 0.9, 1.0, -3.0, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in scores], "__p double")
    placed = m.with_range(df, (F.array(*(F.lit(e) for e in edges)), 8)).collect()
    expected = [0 if v is None else len(edges) if math.isnan(v) else sum(e <= v for e in edges) for v in scores]
    assert [r["__bucket"] for r in placed] == expected
    none = m.with_range(df, (F.array().cast("array<double>"), 8)).collect()
    assert {r["__bucket"] for r in none} == {0}


def test_values_with_equal_hashes_are_apart(spark):
    """Segment values that Spark hashes alike are groups of their own, in every score range."""
    named = spark.range(300_000).select(F.col("id").cast("string").alias("v"))
    one, two = named.groupBy(F.hash("v").alias("h")).agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("a", "b").first()
    rows = [(v, "x", int((i * 7 + k) % 3 == 0), ((i * 13 + k) % 50) / 50.0) for k, v in enumerate((one, two)) for i in range(200 + 50 * k)]
    df = spark.createDataFrame(rows, "v string, o string, y int, p double")
    got = {r["value"]: r for r in s.subgroup_metrics(df, ["v", "o"], buckets=4).where("segment = 'v'").collect()}
    for v in (one, two):
        alone = m.binary_metrics(df.where(F.col("v") == v)).first()
        assert got[v]["sample_count"] == alone["sample_count"]
        assert abs(got[v]["roc_auc"] - alone["roc_auc"]) < 1e-9 and abs(got[v]["average_precision"] - alone["average_precision"]) < 1e-9
