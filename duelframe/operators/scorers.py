"""Probability from a feature row array: fixed weights or a fitted Spark ML model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.values import sigmoid

Calibrator = Callable[[Column], Column]


@dataclass(frozen=True)
class LinearScorer:
    """Logistic link over a weighted sum; stays inside generated code."""

    weights: Sequence[float]
    intercept: float = 0.0

    def add_probability(self, df: DataFrame, array: str, names: Sequence[str], out: str) -> DataFrame:
        terms = [f"{float(self.intercept)!r}D"] + [f"{float(w)!r}D * get({array}, {i})" for i, w in enumerate(self.weights)]
        return df.withColumn(out, sigmoid(F.expr(" + ".join(terms))))


@dataclass(frozen=True)
class ModelScorer:
    """Any fitted Spark ML transformer with a probability vector or a score column."""

    model: object
    probability: str = "probability"
    score: str | None = None
    positive_index: int = 1

    def add_probability(self, df: DataFrame, array: str, names: Sequence[str], out: str) -> DataFrame:
        # the row travels as one struct, so model columns cannot clash with its own
        framed = df.select(F.struct("*").alias("__row"), *[F.get(array, F.lit(i)).alias(n) for i, n in enumerate(names)])
        # rows in error have no features; the model never sees them
        usable = F.array(*[F.col(f"`{n}`") for n in names])
        framed = framed.withColumn("__usable", ~F.exists(usable, lambda v: v.isNull() | F.isnan(v)))
        framed = framed.withColumns({n: F.when(F.col("__usable"), F.col(f"`{n}`")).otherwise(F.lit(0.0)) for n in names})
        scored = self.model.transform(framed)
        if self.score is not None:
            value = sigmoid(F.col(self.score))
        else:
            value = F.get(vector_to_array(self.probability), F.lit(self.positive_index))
        return scored.select("__row.*", F.when(F.col("__usable"), value).alias(out))


def positive_probability(model, df: DataFrame, out: str = "p", probability: str = "probability", index: int = 1) -> DataFrame:
    """Scored table with the positive-class probability as a double column."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.get(vector_to_array(probability), F.lit(index)).alias(out))
