"""Isotonic regression pooled in score ranges and merged by block summaries.

Adjacent violators are pooled inside ranges of the score, each in a task of its own; what leaves a range are its blocks, and
blocks of many ranges are pooled again until one range is left. Pooling blocks gives what pooling all rows would give,
as a block never has to be split again. With 0/1 targets the blocks of n rows have different rates, so there are
at most about n ** (2 / 3) of them in the worst case and few in practice; only they come together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.values import clip
from duelframe.operators.metrics import range_edges, with_range

_BLOCKS = "part int, lower double, upper double, weight double, total double"
_RANGES_A_MERGE = 64


def pool(lower: np.ndarray, upper: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[list[float]]:
    """Blocks (lower, upper, weight, total) with increasing means out of ascending ones; equal means are one block."""
    out: list[list[float]] = []
    for block in zip(lower.tolist(), upper.tolist(), weight.tolist(), total.tolist()):
        now = list(block)
        while out and out[-1][3] * now[2] >= now[3] * out[-1][2]:
            before = out.pop()
            now = [before[0], now[1], before[2] + now[2], before[3] + now[3]]
        out.append(now)
    return out


def _pooled(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("lower")
    blocks = pool(*(frame[c].to_numpy() for c in ("lower", "upper", "weight", "total")))
    return pd.DataFrame([[int(frame["part"].iloc[0]), *b] for b in blocks], columns=["part", "lower", "upper", "weight", "total"])


def fit_isotonic(df: DataFrame, y: str = "y", p: str = "p", *, buckets: int | None = None) -> DataFrame:
    """Steps of the fit: lower, upper (smallest and largest score), value and weight (rows), in no order.

    Null and NaN scores take no part. The blocks are persisted between merges and released by Spark when they are no longer referenced.
    """
    scored = df.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(F.col(p).cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("double")).alias("__pos"))
    ranged = with_range(scored, range_edges(scored, buckets=buckets))
    blocks = ranged.select(F.col("__bucket").alias("part"), F.col("__p").alias("lower"), F.col("__p").alias("upper"), F.col("__n").cast("double").alias("weight"), F.col("__pos").alias("total"))
    blocks = blocks.groupBy("part").applyInPandas(_pooled, _BLOCKS).persist()
    last = blocks.agg(F.max("part")).first()[0] or 0
    while last > 0:
        merged = blocks.withColumn("part", F.expr(f"part div {_RANGES_A_MERGE}").cast("int"))
        blocks = merged.groupBy("part").applyInPandas(_pooled, _BLOCKS)
        last //= _RANGES_A_MERGE
    return blocks.select("lower", "upper", (F.col("total") / F.col("weight")).alias("value"), F.col("weight").cast("bigint").alias("weight"))


def points(steps: DataFrame) -> DataFrame:
    """One row with the corners of the map: ascending scores `xs` and their values `ys`, linear between them."""
    corners = F.array(F.struct(F.col("lower").alias("x"), F.col("value").alias("y")), F.struct(F.col("upper").alias("x"), F.col("value").alias("y")))
    each = steps.select(F.explode(F.array_distinct(corners)).alias("c"))
    one = each.agg(F.array_sort(F.collect_list("c")).alias("c"))
    return one.select(F.col("c.x").alias("xs"), F.col("c.y").alias("ys"))


def between(xs: Column, ys: Column, p: Column, most: int) -> Column:
    """Value of the map at a score: binary search for the corner below, then a straight line; clamped at the ends."""
    steps = F.array(*(F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)))
    above = F.aggregate(steps, F.lit(0), lambda at, width: F.when(F.get(xs, at + width - 1) <= p, at + width).otherwise(at))

    def value(at: Column) -> Column:
        x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
        inner = y0 + (y1 - y0) * F.try_divide(p - x0, x1 - x0)
        return clip(F.when(at == 0, F.get(ys, F.lit(0))).when(at == F.size(xs), y0).otherwise(inner), 0.0, 1.0)

    # the place is searched once, however often it is looked at
    return F.get(F.transform(F.array(above), value), F.lit(0))


def apply_isotonic(df: DataFrame, steps: DataFrame, p: str = "p", *, out: str = "calibrated") -> DataFrame:
    """The fitted map as a column. The steps stay a table, read once by a subquery, and are no part of the plan."""
    corners = points(steps)
    framed = df.withColumns({"__xs": corners.select("xs").scalar(), "__ys": corners.select("ys").scalar()})
    return framed.withColumn(out, between(F.col("__xs"), F.col("__ys"), F.col(p), 1 << 24)).drop("__xs", "__ys")
