"""Probability calibration fitted on validation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.text import sql_array
from duelframe.functions.values import clip, logit, row_log_loss
from duelframe.operators.isotonic import between, fit_isotonic, points
from duelframe.operators.metrics import assert_predictions

METHODS = ("none", "sigmoid", "isotonic")


@dataclass(frozen=True)
class Identity:
    def __call__(self, p: Column) -> Column:
        return p


@dataclass(frozen=True)
class Sigmoid:
    """Logistic map of the logit; a closed-form column expression."""

    slope: float
    intercept: float

    def __call__(self, p: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(F.lit(self.slope) * logit(p) + F.lit(self.intercept))))


@dataclass(frozen=True)
class Isotonic:
    """Non-decreasing step map, linear between steps, clamped at the ends.

    The corners of a saved fit are constants of the plan and searched by halves. A fit of very many steps is applied
    as a table by `isotonic.apply_isotonic`.
    """

    boundaries: tuple[float, ...]
    predictions: tuple[float, ...]

    def __call__(self, p: Column) -> Column:
        return between(F.expr(sql_array(self.boundaries)), F.expr(sql_array(self.predictions)), p, len(self.boundaries))


@dataclass(frozen=True)
class CalibrationFit:
    method: str
    calibrator: object
    sample_count: int
    positive_count: int
    log_loss_before: float
    log_loss_after: float
    brier_before: float
    brier_after: float


def apply_calibration(calibrator, p: Column) -> Column:
    """Calibrated probability clipped to [0, 1]."""
    return clip(calibrator(p), 0.0, 1.0)


def calibration_summary(df: DataFrame, calibrator, y: str = "y", p: str = "p") -> DataFrame:
    """Losses before and after on the same rows, one pass."""
    target, before = F.col(y), F.col(p)
    staged = df.withColumn("__after", apply_calibration(calibrator, before))
    after = F.col("__after")
    return staged.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(target).cast("bigint").alias("positive_count"),
        F.avg(row_log_loss(target, before)).alias("log_loss_before"),
        F.avg(row_log_loss(target, after)).alias("log_loss_after"),
        F.avg((before - target) * (before - target)).alias("brier_before"),
        F.avg((after - target) * (after - target)).alias("brier_after"),
    )


def fit_calibrator(
    df: DataFrame, y: str = "y", p: str = "p", *, method: str = "sigmoid", min_isotonic: int = 300, min_isotonic_class: int = 30
) -> CalibrationFit:
    """Fit on held-out rows only. Isotonic needs enough rows, classes and distinct scores."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    assert_predictions(df, y, p)
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).alias("pos")).first()
    if counts["pos"] in (0, counts["n"]):
        raise ValueError("calibration data must contain both classes")
    if method == "none":
        calibrator = Identity()
    elif method == "sigmoid":
        frame = df.select(logit(p).alias("__x"), F.col(y).cast("double").alias("__t"))
        rows = VectorAssembler(inputCols=["__x"], outputCol="features").transform(frame)
        estimator = LogisticRegression(
            featuresCol="features", labelCol="__t", standardization=False, regParam=1.0 / (1e6 * counts["n"]), maxIter=2000, tol=1e-10
        )
        model = estimator.fit(rows)
        calibrator = Sigmoid(float(model.coefficients[0]), float(model.intercept))
    else:
        if counts["n"] < min_isotonic:
            raise ValueError(f"isotonic calibration needs at least {min_isotonic} rows")
        if min(counts["pos"], counts["n"] - counts["pos"]) < min_isotonic_class:
            raise ValueError("isotonic calibration has too few rows in one class")
        if len(df.select(p).distinct().limit(10).collect()) < 10:
            raise ValueError("isotonic calibration needs at least 10 distinct probabilities")
        # the steps, not the rows, come to the driver: they are saved with the run
        corners = points(fit_isotonic(df, y, p)).first()
        calibrator = Isotonic(tuple(corners["xs"]), tuple(corners["ys"]))
    row = calibration_summary(df, calibrator, y, p).first()
    return CalibrationFit(method=method, calibrator=calibrator, **row.asDict())


def calibrated_classifier(df: DataFrame, calibrator, p: str = "p", *, threshold: float = 0.5) -> DataFrame:
    """Both class probabilities and the label at a threshold."""
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must lie strictly between 0 and 1")
    staged = df.withColumn("probability_1", apply_calibration(calibrator, F.col(p)))
    return staged.withColumns(
        {"probability_0": 1.0 - F.col("probability_1"), "label": F.when(F.col("probability_1") >= threshold, 1).otherwise(0)}
    )
