"""Spark ML fits: standardised logistic regression and boosted trees, with search."""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.values import row_log_loss

MAX_LOGISTIC, MAX_TREES, MAX_TRIALS = 24, 16, 100
FEATURES, TARGET = "features", "__y"


@dataclass(frozen=True)
class LogisticCandidate:
    name: str
    penalty: str
    c: float
    l1_ratio: float | None = None
    max_iter: int = 5000
    tolerance: float = 1e-4
    balanced: bool = False

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("candidate name must not be empty")
        if self.penalty not in ("l2", "elasticnet"):
            raise ValueError("penalty must be 'l2' or 'elasticnet'")
        if not 1e-4 <= self.c <= 1e3:
            raise ValueError("c must be in [1e-4, 1e3]")
        if (self.penalty == "elasticnet") != (self.l1_ratio is not None):
            raise ValueError("l1_ratio belongs to elastic-net candidates only")
        if self.l1_ratio is not None and not 0.0 <= self.l1_ratio <= 1.0:
            raise ValueError("l1_ratio must be in [0, 1]")
        if not 100 <= self.max_iter <= 20_000:
            raise ValueError("max_iter must be in [100, 20_000]")
        if not 1e-8 <= self.tolerance <= 1e-1:
            raise ValueError("tolerance must be in [1e-8, 1e-1]")


def logistic_grid(
    c_values: Sequence[float] = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0),
    l1_ratios: Sequence[float] = (0.1, 0.5, 0.9),
    *,
    penalty: str = "both",
    **common,
) -> list[LogisticCandidate]:
    """L2 for every C, elastic net for every C and ratio; at most 24 candidates."""
    grid = []
    if penalty in ("l2", "both"):
        grid += [LogisticCandidate(f"l2_c_{c:g}", "l2", c, **common) for c in c_values]
    if penalty in ("elasticnet", "both"):
        grid += [
            LogisticCandidate(f"elasticnet_c_{c:g}_l1_{r:g}", "elasticnet", c, r, **common) for c in c_values for r in l1_ratios
        ]
    _check_candidates(grid, MAX_LOGISTIC)
    return grid


def _check_candidates(candidates: Sequence, bound: int) -> None:
    if not candidates:
        raise ValueError("at least one candidate is required")
    if len(candidates) > bound:
        raise ValueError(f"received {len(candidates)} candidates; the bound is {bound}")
    names = [c.name for c in candidates]
    if len(set(names)) != len(names):
        raise ValueError("candidate names must be unique")


# --- standardisation -----------------------------------------------------------------


def moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature, one pass; zero deviation becomes 1."""
    quoted = [F.col(f"`{n}`").cast("double") for n in names]
    one_row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(quoted)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(quoted)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean"),
                F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"),
            )
            for i, n in enumerate(names)
        ]
    )
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def scaling_stages(df: DataFrame, names: Sequence[str]) -> list:
    """Persistable stages that standardise with the moments of `df` and assemble a vector.

    The moments (two numbers per feature) are written into a generated SELECT, so
    scaling is ordinary generated code and follows the model when it is saved.
    """
    found = {r["feature"]: r for r in moments(df, names).collect()}
    terms = [
        f"(CAST(`{n}` AS DOUBLE) - {found[n]['mean']!r}D) / {found[n]['scale']!r}D AS `__z{i}`" for i, n in enumerate(names)
    ]
    statement = "SELECT *, " + ", ".join(terms) + " FROM __THIS__"
    assembler = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(names))], outputCol=FEATURES)
    return [SQLTransformer(statement=statement), assembler]


def _assembled(df: DataFrame, stages: Sequence) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df


def class_counts(df: DataFrame, target: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(target) == 0).alias("zeros"), F.count_if(F.col(target) == 1).alias("ones")).first()
    if not row["zeros"] or not row["ones"]:
        raise ValueError("training target must contain both classes")
    return row["zeros"], row["ones"]


# --- logistic regression -------------------------------------------------------------------


@dataclass
class LogisticFit:
    model: PipelineModel
    candidate: LogisticCandidate
    iterations: int
    retried: bool
    converged: bool


def _fit_scaled(train: DataFrame, candidate: LogisticCandidate, counts: tuple[int, int], stages: Sequence, cap: int) -> LogisticFit:
    """Fit on an assembled table. The objective maps as regParam = 1 / (C n)."""
    zeros, ones = counts
    rows = zeros + ones
    estimator = LogisticRegression(
        featuresCol=FEATURES, labelCol=TARGET, standardization=False, regParam=1.0 / (candidate.c * rows),
        elasticNetParam=candidate.l1_ratio or 0.0, tol=candidate.tolerance, maxIter=candidate.max_iter,
    )
    if candidate.balanced:
        estimator = estimator.setWeightCol("__w")
        weight = F.when(F.col(TARGET) == 1, F.lit(rows / (2.0 * ones))).otherwise(F.lit(rows / (2.0 * zeros)))
        train = train.withColumn("__w", weight)
    limit, retried = candidate.max_iter, False
    model = estimator.fit(train)
    used = model.summary.totalIterations
    if used >= limit:
        retried, limit = True, min(candidate.max_iter * 3, cap)
        model = estimator.setMaxIter(limit).fit(train)
        used = model.summary.totalIterations
    return LogisticFit(PipelineModel(stages=[*stages, model]), candidate, used, retried, used < limit)


def fit_logistic(df: DataFrame, names: Sequence[str], target: str, candidate: LogisticCandidate, *, max_iter_cap: int = 20_000) -> LogisticFit:
    """One candidate: scale on these rows, fit, refit once with more iterations if needed."""
    counts = class_counts(df, target)
    stages = scaling_stages(df, names)
    train = _assembled(df.select(*names, F.col(target).cast("double").alias(TARGET)), stages).select(FEATURES, TARGET).persist()
    try:
        fit = _fit_scaled(train, candidate, counts, stages, max_iter_cap)
    finally:
        train.unpersist()
    if not fit.converged:
        raise RuntimeError(f"{candidate.name!r} did not converge after {fit.iterations} iterations")
    return fit


def validation_losses(models: Sequence, df: DataFrame, target: str) -> list[float]:
    """Log loss of every model in one pass over the validation rows."""
    scored = df.withColumn(TARGET, F.col(target).cast("int"))
    keep = scored.columns
    losses = []
    for i, model in enumerate(models):
        added = model.transform(scored)
        scored = added.select(*keep, *losses, F.get(vector_to_array("probability"), F.lit(1)).alias(f"__p{i}"))
        losses.append(f"__p{i}")
    row = scored.agg(*[F.avg(row_log_loss(F.col(TARGET), F.col(name))).alias(name) for name in losses]).first()
    return [row[name] for name in losses]


@dataclass
class SearchResult:
    best: object
    loss: float
    trials: list[dict]

    def table(self, spark) -> DataFrame:
        schema = "name string, validation_log_loss double, detail string, error string"
        return spark.createDataFrame([(t["name"], t["loss"], t["detail"], t["error"]) for t in self.trials], schema)


def _run_parallel(function, candidates: Sequence, parallelism: int) -> list:
    """Independent fits submitted as concurrent Spark jobs; a failure is a result."""

    def guarded(candidate):
        try:
            return function(candidate)
        except (ValueError, RuntimeError, ArithmeticError) as error:
            return error

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(guarded, candidates))


def search_logistic(
    train: DataFrame, validation: DataFrame, names: Sequence[str], target: str,
    candidates: Sequence[LogisticCandidate], *, parallelism: int = 4,
) -> SearchResult:
    """Lowest validation log loss; ties prefer L2, then the smaller C."""
    _check_candidates(candidates, MAX_LOGISTIC)
    counts = class_counts(train, target)
    stages = scaling_stages(train, names)
    assembled = _assembled(train.select(*names, F.col(target).cast("double").alias(TARGET)), stages).select(FEATURES, TARGET).persist()
    try:
        fits = _run_parallel(lambda c: _fit_scaled(assembled, c, counts, stages, 20_000), candidates, parallelism)
    finally:
        assembled.unpersist()
    good = [f for f in fits if isinstance(f, LogisticFit) and f.converged]
    losses = dict(zip([f.candidate.name for f in good], validation_losses([f.model for f in good], validation, target))) if good else {}
    trials = []
    for candidate, fit in zip(candidates, fits):
        failed = isinstance(fit, Exception)
        error = f"{type(fit).__name__}: {fit}" if failed else (None if fit.converged else "did not converge")
        detail = "" if failed else f"iterations={fit.iterations} retried={fit.retried}"
        trials.append({"name": candidate.name, "loss": losses.get(candidate.name), "detail": detail, "error": error})
    if not good:
        raise RuntimeError("all logistic candidates failed: " + "; ".join(f"{t['name']}: {t['error']}" for t in trials))
    best = min(good, key=lambda f: (losses[f.candidate.name], f.candidate.penalty != "l2", f.candidate.c))
    return SearchResult(best, losses[best.candidate.name], trials)


def coefficient_table(spark, weights: Sequence[float], scale_table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Standardised, raw-unit and odds-ratio coefficients, largest first."""
    rows = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(names, weights))], "position int, feature string, w double")
    return (
        rows.join(scale_table, "feature")
        .select(
            "position", "feature", F.col("w").alias("standardized_coefficient"), (F.col("w") / F.col("scale")).alias("raw_unit_coefficient"),
            F.exp("w").alias("odds_ratio_per_standard_deviation"), F.col("mean"),
        )
        .orderBy(F.desc(F.abs("standardized_coefficient")), "position")
    )


def raw_intercept(coefficients: DataFrame, intercept: float) -> DataFrame:
    """Intercept for features in their raw units."""
    shift = F.sum(F.col("raw_unit_coefficient") * F.col("mean"))
    return coefficients.agg((F.lit(float(intercept)) - shift).alias("raw_intercept"))


# --- boosted trees ------------------------------------------------------------------------------


@dataclass(frozen=True)
class TreeCandidate:
    """Tree settings. Penalty terms on leaf weights have no counterpart in Spark ML."""

    name: str
    max_depth: int
    learning_rate: float
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    gamma: float = 0.0
    rounds: int = 100
    max_bin: int = 256

    def __post_init__(self) -> None:
        for label, (low, high) in fv.TREE_LIMITS.items():
            if not low <= getattr(self, label) <= high:
                raise ValueError(f"{label} lies outside {low} to {high}")


def default_trees(rounds: int = 100) -> list[TreeCandidate]:
    return [TreeCandidate(*settings, rounds=rounds) for settings in fv.DEFAULT_TREES]


@dataclass
class TreeFit:
    model: PipelineModel
    candidate: TreeCandidate
    best_round: int


def best_round(losses: Sequence[float], patience: int) -> int:
    """Round of the lowest loss before `patience` rounds pass without a new low."""
    best, best_loss = 0, float("inf")
    for i, loss in enumerate(losses):
        if loss < best_loss:
            best, best_loss = i, loss
        elif i - best >= patience:
            break
    return best + 1


def _tree_rows(df: DataFrame, names: Sequence[str], target: str) -> tuple[VectorAssembler, DataFrame]:
    """The assembler and the rows that trees are fitted on."""
    assembler = VectorAssembler(inputCols=list(names), outputCol=FEATURES)
    numbers = df.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names], F.col(target).cast("double").alias(TARGET))
    return assembler, assembler.transform(numbers).select(FEATURES, TARGET)


def fit_trees(
    train: DataFrame, validation: DataFrame, names: Sequence[str], target: str, candidate: TreeCandidate,
    *, patience: int = 50, seed: int = 42,
) -> TreeFit:
    """Fit until `patience` rounds bring no new low on validation, and keep the best round."""
    assembler, rows = _tree_rows(train, names, target)
    _, held = _tree_rows(validation, names, target)
    rows, held = rows.persist(), held.persist()
    try:
        return _fit_rows(assembler, rows, held, candidate, patience, seed)
    finally:
        rows.unpersist()
        held.unpersist()


def _fit_rows(assembler: VectorAssembler, rows: DataFrame, held: DataFrame, candidate: TreeCandidate, patience: int, seed: int) -> TreeFit:
    """Rounds are doubled until patience runs out, so that a long limit is paid for only where it is used.

    With one seed the first rounds of a longer fit are those of a shorter one.
    """
    estimator = GBTClassifier(
        featuresCol=FEATURES, labelCol=TARGET, maxDepth=candidate.max_depth, stepSize=candidate.learning_rate,
        maxIter=candidate.rounds, subsamplingRate=candidate.subsample, maxBins=candidate.max_bin,
        minInstancesPerNode=max(1, round(candidate.min_child_weight)), minInfoGain=candidate.gamma,
        featureSubsetStrategy=str(float(candidate.colsample)) if candidate.colsample < 1.0 else "all", seed=seed,
    )
    tried = min(candidate.rounds, 2 * patience)
    while True:
        model = estimator.setMaxIter(tried).fit(rows)
        rounds = best_round(model.evaluateEachIteration(held), patience)
        if tried == candidate.rounds or rounds + patience <= tried:
            break
        tried = min(candidate.rounds, 2 * tried)
    if rounds < tried:
        model = estimator.setMaxIter(rounds).fit(rows)
    return TreeFit(PipelineModel(stages=[assembler, model]), candidate, rounds)


def search_trees(
    train: DataFrame, validation: DataFrame, names: Sequence[str], target: str, candidates: Sequence[TreeCandidate],
    *, bound: int = MAX_TREES, patience: int = 50, seed: int = 42, parallelism: int = 2,
) -> SearchResult:
    """Lowest validation log loss; ties prefer shallower trees, then fewer rounds."""
    _check_candidates(candidates, bound)
    # all candidates share one copy of the shaped rows
    assembler, rows = _tree_rows(train, names, target)
    _, held = _tree_rows(validation, names, target)
    rows, held = rows.persist(), held.persist()
    try:
        fits = _run_parallel(lambda c: _fit_rows(assembler, rows, held, c, patience, seed), candidates, parallelism)
    finally:
        rows.unpersist()
        held.unpersist()
    good = [f for f in fits if isinstance(f, TreeFit)]
    losses = dict(zip([f.candidate.name for f in good], validation_losses([f.model for f in good], validation, target))) if good else {}
    trials = []
    for candidate, fit in zip(candidates, fits):
        failed = isinstance(fit, Exception)
        trials.append(
            {
                "name": candidate.name, "loss": losses.get(candidate.name), "detail": "" if failed else f"best_round={fit.best_round} {asdict(candidate)}",
                "error": f"{type(fit).__name__}: {fit}" if failed else None,
            }
        )
    if not good:
        raise RuntimeError("all tree candidates failed")
    best = min(good, key=lambda f: (losses[f.candidate.name], f.candidate.max_depth, f.best_round))
    return SearchResult(best, losses[best.candidate.name], trials)


@dataclass(frozen=True)
class TreeSpace:
    """Bounds of the random search; rate and child weight are drawn on a log scale."""

    max_depth: tuple[int, int] = fv.TREE_SPACE["max_depth"]
    learning_rate: tuple[float, float] = fv.TREE_SPACE["learning_rate"]
    min_child_weight: tuple[float, float] = fv.TREE_SPACE["min_child_weight"]
    subsample: tuple[float, float] = fv.TREE_SPACE["subsample"]
    colsample: tuple[float, float] = fv.TREE_SPACE["colsample"]
    gamma: tuple[float, float] = fv.TREE_SPACE["gamma"]
    max_bin: tuple[int, int] = fv.TREE_SPACE["max_bin"]
    rounds: tuple[int, int] = fv.TREE_SPACE["rounds"]

    def draw(self, trials: int, seed: int = 42) -> list[TreeCandidate]:
        if not 1 <= trials <= MAX_TRIALS:
            raise ValueError(f"trials must be in [1, {MAX_TRIALS}]")
        source = random.Random(seed)
        log_draw = lambda bounds: bounds[0] * (bounds[1] / bounds[0]) ** source.random()
        return [
            TreeCandidate(
                f"trial_{i}", source.randint(*self.max_depth), log_draw(self.learning_rate), log_draw(self.min_child_weight),
                source.uniform(*self.subsample), source.uniform(*self.colsample), source.uniform(*self.gamma),
                source.randint(*self.rounds), source.randint(*self.max_bin),
            )
            for i in range(trials)
        ]


def tune_trees(train, validation, names, target, *, trials: int = 30, space: TreeSpace = TreeSpace(), seed: int = 42, **options) -> SearchResult:
    """Seeded random search inside the bounds."""
    return search_trees(train, validation, names, target, space.draw(trials, seed), bound=MAX_TRIALS, seed=seed, **options)


def importance_table(spark, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Tree importances, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    if len(values) != len(names):
        raise ValueError("importance length does not match the feature list")
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
