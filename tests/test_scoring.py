"""Scoring plan: symmetry, error order, grading, plan shape, stream and end-to-end runs."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.operators import confidence, models, pairing, quality, serving, splits
from duelframe.operators.calibration import Isotonic, fit_calibrator
from duelframe.operators.scorers import LinearScorer
from duelframe.plans.prepare import DataPlan, prepare
from duelframe.plans.score import ScoringPlan, rejection_table, score_requests, split_outcomes
from duelframe.plans.train import TrainPlan, evaluate_final, scoring_plan, train
from duelframe.registry import matchups
from duelframe.sources import lineage, runs
from duelframe.streaming.requests import score_stream

SNAP = (
    "fighter_id string, fighter_name string, as_of_date date, last_fight_date date, dob date, last_division string, stance string, "
    "feature_prior_fights double, feature_career_minutes double, feature_age_years double, feature_elo_global double, feature_stance_missing double"
)
DAY = date(2024, 6, 1)
ROWS = [
    ("aaaaaaaaaaaaaaa1", "Ann", DAY, date(2024, 1, 1), date(1990, 1, 1), "M_LIGHT", "Orthodox", 5.0, 50.0, 1.0, 1600.0, 0.0),
    ("aaaaaaaaaaaaaaa2", "Bo", DAY, date(2023, 1, 1), None, "Lightweight", "orthodox ", 0.0, 0.0, 28.0, 1500.0, 0.0),
    ("aaaaaaaaaaaaaaa3", "Cy", DAY, None, date(1995, 1, 1), "M_FLY", None, 9.0, 90.0, 1.0, 1550.0, 1.0),
    ("aaaaaaaaaaaaaaa4", "Di", DAY, date(2024, 1, 1), date(1990, 1, 1), "M_LIGHT", "Switch", 7.0, 70.0, 1.0, None, 0.0),
    ("aaaaaaaaaaaaaaa5", "Bo", date(2024, 7, 1), None, date(1990, 1, 1), "M_LIGHT", None, 7.0, 70.0, 1.0, 1500.0, 0.0),
]
FEATURES = (
    "feature_a_minus_b_prior_fights", "feature_a_minus_b_elo_global", "feature_a_minus_b_age_years", "feature_division_lbs", "feature_same_known_stance",
    "feature_exactly_one_debutant", "feature_mean_elo_global",
)
PLAN = ScoringPlan(features=FEATURES, scorer=LinearScorer((0.1, 0.01, -0.02, 0.001, 0.1, 0.2, 0.0001), -0.3), cutoff="2024-06-01")


@pytest.fixture(scope="module")
def snaps(spark):
    return spark.createDataFrame(ROWS, SNAP)


def ask(spark, rows):
    schema = "request_id int, query_a string, query_b string, id_b string, division string, division_lbs double, predicted_at timestamp"
    return spark.createDataFrame(rows, schema).withColumn("predicted_at", F.coalesce("predicted_at", F.lit("2024-06-10").cast("timestamp")))


def test_swapping_sides_swaps_probabilities(spark, snaps):
    out = score_requests(ask(spark, [(1, "ann", "bo", "aaaaaaaaaaaaaaa2", "M_LIGHT", None, None), (2, "cy", "Ann", None, "M_LIGHT", None, None)]), snaps, PLAN)
    back = score_requests(ask(spark, [(2, "Ann", "Cy", None, "M_LIGHT", None, None)]), snaps, PLAN).first()
    rows = {r["request_id"]: r for r in out.collect()}
    assert rows[2]["probability_a"] == pytest.approx(1 - back["probability_a"], abs=1e-12)
    r = rows[1]
    assert r["error_code"] is None and r["prior_ufc_fights_b"] == 0
    ab, ba = r["features_a_vs_b"], r["features_b_vs_a"]
    for name in FEATURES:
        assert ab[name] == (-ba[name] if name.startswith(fv.DIFFERENCE_PREFIX) else ba[name])
    assert ab["feature_same_known_stance"] == 1.0 and ab["feature_division_lbs"] == 155.0
    codes = [w["code"] for w in r["warnings"]]
    assert codes[:2] == ["debut", "limited_history"] and "after_cutoff" in codes
    assert r["warnings"][0]["details"] == {"fighters": "fighter_b"}


def test_first_error_in_stage_order(spark, snaps):
    early = date(2024, 6, 1)
    at = lambda d: __import__("datetime").datetime(d.year, d.month, d.day)
    rows = [
        (1, " ", "Ann", None, None, None, None),
        (2, "nobody", "bo", None, None, None, None),
        (3, "Ann", "bo", None, None, None, None),
        (4, "Ann", "aaaaaaaaaaaaaaa1", None, None, None, None),
        (5, "Ann", "Cy", None, None, None, at(early)),
        (6, "Ann", "Cy", None, None, None, None),
        (7, "Ann", "Cy", None, "M_FLY", 130.0, None),
        (8, "Ann", "Di", None, "M_LIGHT", None, None),
        (9, "Ann", "bo", "aaaaaaaaaaaaaaa5", "M_LIGHT", None, None),
        (10, "Ann", "cy", "aaaaaaaaaaaaaaa1", "M_LIGHT", None, None),
        (11, "Ann", "Cy", None, "Super Heavy", None, None),
        (12, "x" * 161, "Ann", None, None, None, None),
    ]
    got = {r["request_id"]: r["error_code"] for r in score_requests(ask(spark, rows), snaps, PLAN).collect()}
    assert got == {
        1: "invalid_query", 2: "not_found", 3: "ambiguous", 4: "same_entity", 5: "snapshot_unavailable", 6: "class_required",
        7: "class_weight_conflict", 8: "rating_missing", 9: "snapshot_unavailable", 10: "identity_mismatch", 11: "class_unsupported", 12: "invalid_query",
    }
    gated = ScoringPlan(features=FEATURES, scorer=PLAN.scorer, cutoff="2024-06-01", allow_post_cutoff=False)
    got = {r["request_id"]: r["error_code"] for r in score_requests(ask(spark, rows[:2]), snaps, gated).collect()}
    assert got == {1: "invalid_query", 2: "post_cutoff_disabled"}


def test_class_state_guard(spark, snaps):
    plan = ScoringPlan(features=(*FEATURES, "feature_min_division_elo_fights"), scorer=LinearScorer((0.0,) * 8), cutoff="2024-06-01")
    out = score_requests(ask(spark, [(1, "Ann", "Cy", None, "M_LIGHT", None, None), (2, "Ann", "bo", "aaaaaaaaaaaaaaa2", "M_FLY", None, None)]), snaps, plan)
    assert {r["request_id"]: r["error_code"] for r in out.collect()} == {1: "class_state_mismatch", 2: "class_state_mismatch"}


def test_public_view_and_rejections(spark, snaps):
    scored = score_requests(ask(spark, [(1, "Ann", "Cy", None, "M_LIGHT", None, None), (2, "Ann", "Bo", "aaaaaaaaaaaaaaa5", "M_LIGHT", None, None)]), snaps, PLAN)
    predictions, rejected = split_outcomes(scored)
    shown = serving.public_predictions(predictions, keep=["request_id"])
    text = shown.toJSON().first() if hasattr(shown, "toJSON") else json.dumps(shown.first().asDict(True), default=str)
    assert "aaaaaaaaaaaaaaa" not in text and "details" not in text
    row = rejection_table(rejected, snaps).first()
    assert row["error_message"].startswith("Bo has no snapshot available before the current server date (2024-06-10).")
    assert "2024-07-01 through 2024-07-01" in row["error_message"]


def test_score_never_rises_with_a_condition(spark):
    base = dict(prior_a="5", prior_b="5", disagreement="0.0D", snapshot_age_a="1", snapshot_age_b="1", layoff_a="10", layoff_b="10",
                after_cutoff="0", out_of_range=f"CAST(array() AS {pairing.RANGE_HITS})", unsupported="CAST(array() AS array<string>)")
    one_row = spark.range(1)
    score = lambda **kw: confidence.with_support_grade(one_row, **{**base, **kw}).first()["confidence_score"]
    assert score() == 1.0
    worse = [
        dict(prior_a="0"), dict(prior_a="0", prior_b="0"), dict(prior_b="2"), dict(snapshot_age_a="181"), dict(snapshot_age_a="731"),
        dict(layoff_b="1096"), dict(after_cutoff="1"), dict(after_cutoff="366"), dict(disagreement="0.1D"), dict(disagreement="0.2D"), dict(unsupported="array('x')"),
    ]
    got = [score(**w) for w in worse]
    assert got == [0.56, 0.44, 0.86, 0.84, 0.75, 0.87, 0.97, 0.85, 0.83, 0.68, 0.65]
    assert confidence.with_support_grade(one_row, **{**base, "unsupported": "array('x')"}).first()["confidence_tier"] == "unsupported"


def test_plan_shape(spark, sf):
    """No cross join, and Python only for names that are not ASCII."""
    scored = score_requests(matchups.scoring_requests(spark, sf), matchups.scoring_snapshots(spark, sf), matchups.scoring_plan())
    text = scored._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text
    plain = ScoringPlan(**{**matchups.scoring_plan().__dict__, "ascii_names": True})
    text = score_requests(matchups.scoring_requests(spark, sf), matchups.scoring_snapshots(spark, sf), plain)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in text


def test_metric_scan_reads_two_columns(spark, sf):
    from duelframe.operators.metrics import binary_metrics

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    scored = lines.select((F.col("l_tax") > 0.04).cast("int").alias("y"), (F.col("l_quantity") / 51).alias("p"), "l_shipdate")
    text = binary_metrics(scored, ranking=False)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text


def test_stream_equals_batch_and_restart_adds_nothing(spark, sf, tmp_path):
    requests = matchups.scoring_requests(spark, sf).persist()
    snapshots = matchups.scoring_snapshots(spark, sf).persist()
    plan = matchups.scoring_plan()
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    requests.repartition(3).write.parquet(inbox)
    want = score_requests(requests, snapshots, plan).persist()

    def run():
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
        score_stream(stream, snapshots, plan, out, checkpoint=checkpoint).awaitTermination()
        return spark.read.parquet(f"{out}/predictions").select("request_id", F.round("probability_a", 9)), spark.read.parquet(f"{out}/rejected").select("request_id", "error_code")

    ok, bad = run()
    assert sorted(map(tuple, ok.collect())) == sorted(map(tuple, want.where("error_code IS NULL").select("request_id", F.round("probability_a", 9)).collect()))
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, want.where("error_code IS NOT NULL").select("request_id", "error_code").collect()))
    before = (ok.count(), bad.count())
    ok, bad = run()
    assert (ok.count(), bad.count()) == before


def make_inputs(spark, folder):
    rng = random.Random(11)
    start = date(2020, 1, 1)
    people = [f"{i:016x}" for i in range(30)]
    rows = []
    for i in range(900):
        a, b = rng.sample(people, 2)
        x, prior = rng.gauss(0, 1), float(rng.randint(0, 6))
        rows.append((f"c{i:05d}", (start + timedelta(days=i)).isoformat(), int(rng.random() < 1 / (1 + 2.718 ** (-1.5 * x))), a, "n" + a, b, "n" + b,
                     rng.choice(["M_LIGHT", "W_FLY"]), rng.choice([0.0, 1.0]), x, prior))
    cols = "fight_id event_date target_a_win fighter_a_id fighter_a_name fighter_b_id fighter_b_name division is_title_bout feature_a_minus_b_form feature_min_prior_fights".split()
    spark.createDataFrame(rows, cols).coalesce(1).write.option("header", True).csv(f"{folder}/contests.csv")
    snap = [(p, "Person " + p[-2:], "2022-06-18", "2022-01-01", "1990-01-01", "M_LIGHT", float(i) / 10, float(i % 5)) for i, p in enumerate(people)]
    spark.createDataFrame(snap, "fighter_id fighter_name as_of_date last_fight_date dob last_division feature_form feature_prior_fights".split()).coalesce(1).write.option("header", True).csv(f"{folder}/snapshots.csv")
    spark.createDataFrame([(p, "Person " + p[-2:], "1990-01-01") for p in people], "fighter_id fighter_name dob".split()).coalesce(1).write.option("header", True).csv(f"{folder}/profiles.csv")
    listed = [("target_a_win", "target", "0", "result"), ("feature_a_minus_b_form", "model_feature", "1", ""), ("feature_min_prior_fights", "model_feature", "yes", "")]
    spark.createDataFrame(listed, "column role available_pre_fight description".split()).coalesce(1).write.option("header", True).csv(f"{folder}/dictionary.csv")
    bounds = splits.SplitBounds("2021-06-30", "2021-07-01", "2021-12-31", "2022-01-01", "2022-06-18")
    return DataPlan(f"{folder}/contests.csv", f"{folder}/snapshots.csv", f"{folder}/profiles.csv", f"{folder}/dictionary.csv", bounds, expected_rows=900, expected_features=2)


def test_end_to_end_run(spark, tmp_path):
    folder, root = str(tmp_path / "data"), str(tmp_path / "runs")
    plan = make_inputs(spark, folder)
    prepared = prepare(spark, plan)
    assert prepared.features == ["feature_a_minus_b_form", "feature_min_prior_fights"]
    assert prepared.contests.where("fighter_a_id LIKE '0000%'").count() == 900
    settings = TrainPlan(
        logistic=models.logistic_grid((0.1, 1.0), (0.5,)), trees=[models.TreeCandidate("small", 2, 0.2, rounds=5, max_bin=32)], ablation=False, min_samples=20
    )
    result = train(spark, prepared, settings, root, run_id="run-a")
    assert result.selected.startswith(("logistic", "trees")) and result.validation_log_loss < 0.69
    with pytest.raises(FileExistsError):
        train(spark, prepared, settings, root, run_id="run-a")
    run = runs.load_run(spark, root)
    assert run.feature_names == prepared.features and run.metadata["supported_divisions"] == ["M_LIGHT", "W_FLY"]
    final = evaluate_final(spark, lambda: prepare(spark, plan), root, "run-a", plan=settings).first()
    assert final["sample_count"] == prepared.test.count() and final["log_loss"] < 0.69
    with pytest.raises(FileExistsError):
        evaluate_final(spark, lambda: pytest.fail("test rows must not be read"), root, "run-a", plan=settings)

    asked = spark.createDataFrame([(1, "Person 05", "Person 1a", "M_LIGHT")], "request_id int, query_a string, query_b string, division string")
    asked = asked.withColumn("predicted_at", F.lit("2022-07-01").cast("timestamp"))
    row = score_requests(asked, prepared.snapshots, scoring_plan(run, strict_rating=False)).first()
    assert row["error_code"] is None and 0.0 < row["probability_a"] < 0.5

    changed = f"{root}/components/run_id=run-a"
    spark.read.parquet(changed).withColumn("sha256", F.lit("0" * 64)).limit(1).write.mode("append").parquet(f"{root}/components/run_id=run-b")
    assert runs.run_findings(spark, root, "run-a").count() == 0
    prepared.release()


def test_bad_table_is_reported(spark, tmp_path):
    folder = str(tmp_path / "data")
    plan = make_inputs(spark, folder)
    spark.createDataFrame([("zz", "Ghost", "1990-01-01")], "fighter_id fighter_name dob".split()).coalesce(1).write.option("header", True).mode("append").csv(f"{folder}/profiles.csv")
    with pytest.raises(quality.DataCheckError, match="missing_right"):
        prepare(spark, plan)
    found = prepare(spark, plan, strict=False).findings.where("bad_count > 0").collect()
    assert [(r["check"], list(r["examples"])) for r in found] == [("missing_right", ["zz"])]


def test_isotonic_is_monotone(spark):
    df = spark.range(2000).select((F.rand(3) * 0.9 + 0.05).alias("p")).withColumn("y", (F.rand(5) < F.col("p") * F.col("p")).cast("int")).persist()
    fit = fit_calibrator(df, method="isotonic")
    rows = df.select("p", fit.calibrator(F.col("p")).alias("q")).orderBy("p").collect()
    assert all(a["q"] <= b["q"] + 1e-12 for a, b in zip(rows, rows[1:]))
    assert fit.log_loss_after < fit.log_loss_before
    assert Isotonic((0.2, 0.8), (0.1, 0.9))(F.lit(0.5)) is not None
    with pytest.raises(ValueError, match="at least 300"):
        fit_calibrator(df.limit(100), method="isotonic")


def test_logistic_matches_independent_solution(spark):
    """Penalised logistic regression against Newton steps on the same objective."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2)) * [2.0, 0.5] + [1.0, -3.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - x[:, 1] - 3.5)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int")
    fit = models.fit_logistic(df, ["a", "b"], "y", models.LogisticCandidate("l2", "l2", 0.1, tolerance=1e-8))
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(400)]
    w, ridge = np.zeros(3), np.diag([10.0, 10.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    lr = fit.model.stages[-1]
    assert list(lr.coefficients) == pytest.approx(list(w[:2]), abs=1e-4) and lr.intercept == pytest.approx(w[2], abs=1e-4)


def test_fraction_split_picks_earliest_on_ties(spark):
    rows = [(date(2024, 1, d),) for d in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for _ in range(2)]
    df = spark.createDataFrame(rows, "event_date date")
    assert splits.fraction_cuts(df, "event_date", train_fraction=0.25, validation_fraction=0.3) == (date(2024, 1, 2), date(2024, 1, 5))
    with pytest.raises(quality.DataCheckError):
        splits.fraction_cuts(df.where("event_date < '2024-01-03'"), "event_date")


def test_table_fingerprint_ignores_row_order_only(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", None)], "i int, s string, t string")
    digest = lambda d: lineage.table_fingerprint(d).first()["table_sha256"]
    assert digest(df) == digest(df.orderBy(F.desc("i")))
    assert digest(df) != digest(df.select("i", F.col("t").alias("s"), F.col("s").alias("t")))
    assert digest(df) != digest(df.unionByName(df))


def test_selection_at_the_tolerance(spark):
    from duelframe.operators.selection import select_model

    def decide(tree, logistic, subgroups=None, **kw):
        table = spark.createDataFrame([("t", "trees", tree, 0.02), ("l", "Logistic", logistic, 0.02)], "name string, family string, log_loss double, calibration_error double")
        return select_model(table, subgroups, **kw)

    assert decide(0.5, 0.6)["selected"] == "t"
    tied = decide(0.5, 0.505, tolerance=0.005)
    assert tied["selected"] == "l" and tied["leader"] == "t" and tied["preferred_logistic_on_tie"]
    groups = spark.createDataFrame([("t", "s", "v", 0.9), ("l", "s", "v", 0.8)], "model_name string, segment string, value string, log_loss double")
    assert decide(0.5, 0.6, groups)["selected"] == "l"
    banded = groups.withColumn("segment", F.lit("probability_band"))
    assert decide(0.5, 0.6, banded)["selected"] == "l"


def test_cell_checks_scan_a_table_once(spark, tmp_path):
    from duelframe.sources.tables import RAW, parse_findings

    columns = ", ".join(f"'{'x' if i % 2 else i}' AS {RAW}f{i}, {'CAST(NULL AS DOUBLE)' if i % 2 else f'{i}D'} AS f{i}" for i in range(71))
    spark.sql(f"SELECT {columns} FROM range(20)").write.parquet(str(tmp_path / "cells"))
    found = parse_findings(spark.read.parquet(str(tmp_path / "cells")))
    rows = {r["column"]: (r["bad_count"], r["examples"]) for r in found.collect()}
    assert len(rows) == 71 and rows["f1"] == (20, ["x"]) and rows["f2"] == (0, [])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= 2


def test_sums_of_parts_are_those_of_the_whole(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, f"t{i}" if i % 4 else None, i) for i in range(200)] * 2, "k int, t string, n int")
    whole = lineage.row_sums(df).first()
    parts = lineage.row_sums(df, by=["k"])
    assert parts.count() == 4 and lineage.combined_sums(parts).first() == whole
    rest = lineage.combined_sums(parts, parts.where("k = 1")).first()
    assert rest == lineage.row_sums(df.where("k <> 1 or k is null")).first()
    assert lineage.row_sums(df.limit(0)).first()["row_count"] == 0
    swapped = df.select("k", F.col("t").alias("u"), "n")
    assert lineage.row_sums(swapped).first() == whole  # names belong to the schema text, not to the sums
    assert lineage.row_sums(spark.createDataFrame([(None, "a")], "x string, y string")).first() != lineage.row_sums(spark.createDataFrame([("a", None)], "x string, y string")).first()
    found = {r["k"]: r["finding"] for r in lineage.changed_partitions(parts, lineage.row_sums(df.where("n <> 7"), by=["k"]), ["k"]).collect()}
    assert found == {1: "changed"}


@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_isotonic_ranges_give_the_whole_fit(spark, buckets):
    """Pooling in ranges and merging blocks equals pooling all scores at once; the map equals linear interpolation."""
    import numpy as np

    from duelframe.operators.isotonic import apply_isotonic, fit_isotonic, pool

    rng = np.random.default_rng(buckets)
    p = np.round(rng.random(3_000), 3)
    y = (rng.random(3_000) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1)], "p double, y int").repartition(5)
    xs, at = np.unique(p, return_inverse=True)
    n = np.bincount(at).astype(float)
    want = pool(xs, xs, n, np.bincount(at, weights=y))
    steps = sorted((r["lower"], r["upper"], r["weight"], r["value"]) for r in fit_isotonic(df, buckets=buckets).collect())
    assert [s[:3] for s in steps] == [tuple(b[:3]) for b in want] and [s[3] for s in steps] == pytest.approx([b[3] / b[2] for b in want])
    asked = spark.createDataFrame([(float(v),) for v in np.linspace(-0.2, 1.2, 57)], "p double")
    corners = sorted({(x, s[3]) for s in steps for x in s[:2]})
    got = {r["p"]: r["c"] for r in apply_isotonic(asked, fit_isotonic(df, buckets=buckets), out="c").collect()}
    assert list(got.values()) == pytest.approx(list(np.interp(list(got), *zip(*corners))), abs=1e-12)


def test_only_one_of_many_jobs_commits(spark, tmp_path):
    """Jobs that race for one held-out result: one wins, and only what it wrote is read."""
    from concurrent.futures import ThreadPoolExecutor

    from duelframe.sources import commits

    root = str(tmp_path / "race")

    def job(n):
        try:
            runs.write_final(spark.createDataFrame([(n,)], "sample_count long"), root, "run-a")
            return n
        except FileExistsError:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [n for n in pool.map(job, range(6)) if n is not None]
    assert len(won) == 1 and runs.read_final(spark, root, "run-a").first()["sample_count"] == won[0]
    with pytest.raises(FileExistsError):
        runs.guard_final(spark, root, "run-a")
    runs.write_final(spark.createDataFrame([(77,)], "sample_count long"), root, "run-a", overwrite=True)
    assert runs.read_final(spark, root, "run-a").first()["sample_count"] == 77 and len(commits.records(spark, f"{root}/commits/final", "run-a")) == 2
    with pytest.raises(FileNotFoundError):
        runs.read_final(spark, root, "run")


def test_files_are_hashed_in_pieces(spark, tmp_path):
    """Digests equal hashlib's, also of a file larger than a cell can be and of odd names."""
    import hashlib

    folder = tmp_path / "files"
    folder.mkdir()
    names = {"a b%20.txt": b"x" * 100, "é.bin": b"z", "c": b"y" * (9 << 20)}
    for name, content in names.items():
        (folder / name).write_bytes(content)
    big = folder / "big"
    with open(big, "wb") as out:
        out.truncate((2 << 30) + 17)  # sparse: takes no disk
    want = {name: hashlib.sha256(content).hexdigest() for name, content in names.items()}
    with open(big, "rb") as source:
        want["big"] = hashlib.file_digest(source, "sha256").hexdigest()
    rows = lineage.relative_to(lineage.file_fingerprints(spark, str(folder)), str(folder)).collect()
    assert sorted(r["sha256"] for r in rows) == sorted(want.values()) and {r["size_bytes"] for r in rows} == {100, 1, 9 << 20, (2 << 30) + 17}


def test_trimmed_and_collapsed_texts_match_python_without_regular_expressions(spark):
    from duelframe.functions.text import collapse_spaces, strip

    spaces = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    texts = [f"{c}a{c}{c}b {c}{c}" for c in spaces] + ["", " ", "".join(spaces), "x\n", "a​b", "​", "no space", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = df.select("t", strip("t").alias("s"), collapse_spaces("t").alias("c"))
    for row in shown.collect():
        assert row["s"] == (None if row["t"] is None else row["t"].strip())
        assert row["c"] == (None if row["t"] is None else " ".join(row["t"].split()))
    assert "regexp_replace" not in df.select(strip("t"))._jdf.queryExecution().toString()


def test_class_codes_of_labels_beyond_ascii_need_no_python(spark):
    from duelframe.functions.text import FOLDED_TO_ASCII
    from duelframe.operators.context_class import class_code

    assert FOLDED_TO_ASCII == {chr(i): chr(i).casefold() for i in range(128, 0x110000) if chr(i).casefold().isascii()}
    labels = ["ﬂyweight", "ﬂYWEIGHT Bout", "Women’s Flyweight", "baſketweight", "\xa0Flyweight　", "flyweİght", "Flyweight", None]
    df = spark.createDataFrame([(t,) for t in labels], "t string").select("t", class_code(F.col("t")).alias("c"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    assert [r["c"] for r in df.collect()] == ["M_FLY", "M_FLY", None, None, "M_FLY", None, "M_FLY", None]


def test_lists_of_matches_are_joined_last(spark, sf):
    plan = matchups.lookup_messages(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    outermost = next(line for line in plan.splitlines() if "Join" in line)
    assert "__key" in outermost and "error_code" in outermost


def test_long_lists_are_made_in_slices_and_by_tasks_of_their_own(spark, monkeypatch):
    """No task makes a long message behind a short one, which a writer of pages would not expect."""
    from duelframe.plans import score

    monkeypatch.setattr(score, "_NAMES_A_SLICE", 2, raising=False)
    shown = {"bo": ["Bo", None, "", None, "Bo 4", "Bo 5", ""], "al": ["Al", "Al 1"], "cy": [None, None]}
    people = [(f"{k}{i}", k, name) for k, names in shown.items() for i, name in enumerate(names)]
    index = spark.createDataFrame([(k, i) for i, k, _ in people], "name_key string, entity_id string")
    names = spark.createDataFrame([(i, name) for i, _, name in people], "entity_id string, display_name string")
    asked = [("Bo", None), ("AL", None), ("cy", None), ("nobody", None), ("bo", "x")]
    rows = [(n, "not_found" if q == "nobody" else "ambiguous", q, i) for n, (q, i) in enumerate(asked * 6)] + [(99, "same_entity", None, None)]
    rejected = spark.createDataFrame(rows, "request_id bigint, error_code string, failed_query string, failed_id string").select(
        "request_id", "error_code", *[F.lit(None).cast("string").alias(c) for c in ("query_a", "query_b")],
        *[F.lit(None).cast("date").alias(c) for c in ("ref_date", "available_first", "available_last")], "failed_query", "failed_id",
        *[F.lit(None).cast("string").alias(c) for c in ("failed_entity_id", "failed_side", "failed_state", "failed_label", "failed_class")],
        F.lit(None).cast("struct<n:bigint,day:date>").alias("failed_repeats"),
    )
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        out = rejection_table(rejected, None, names=names, index=index).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(setting, before)
    lists = {"bo": " Matches: Bo, , Bo 4, Bo 5, .", "al": " Matches: Al, Al 1.", "cy": ""}
    want = {n: fv.MSG_AMBIGUOUS + (lists[q.lower()] if i is None else "") for n, code, q, i in rows if code == "ambiguous"}
    assert {r["request_id"]: r["error_message"] for r in out if r["error_code"] == "ambiguous"} == want and len(out) == len(rows)
    for task in {r["task"] for r in out}:
        inside = [r for r in out if r["task"] == task]
        assert len({r["error_code"] == "ambiguous" for r in inside}) == 1
        sizes = [r["error_message"].count(",") for r in inside if "Matches" in r["error_message"]]
        assert sizes == sorted(sizes, reverse=True)
