"""Subgroup diagnostics over any number of segment columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import col
from duelframe.functions.values import experience_band, probability_band
from duelframe.operators.metrics import METRIC_COLUMNS, fold_bins, marked_score, raise_findings, range_edges, ranked_bins, ranked_bins_of_groups, shown_bins


def shown_value(value: Column | str, dtype: str = "string") -> Column:
    """Segment value as text, with a marker for null and NaN."""
    raw = col(value)
    if dtype in ("double", "float"):
        raw = F.when(~F.isnan(raw), raw)
    return F.coalesce(raw.cast("string"), F.lit(fv.MISSING_MARKER))


def _check_names(segments: Sequence[str]) -> None:
    if any(not str(name).strip() for name in segments):
        raise ValueError("segment names must not be empty.")


def unpivot_segments(df: DataFrame, segments: Sequence[str], keep: Sequence[str], *, whole: bool = False) -> DataFrame:
    """One row per (input row, segment); with `whole`, one more with null segment and value."""
    _check_names(segments)
    types = dict(df.dtypes)
    pairs = [F.struct(F.lit(name).alias("segment"), shown_value(f"`{name}`", types[name]).alias("value")) for name in segments]
    if whole:
        pairs.append(F.struct(F.lit(None).cast("string").alias("segment"), F.lit(None).cast("string").alias("value")))
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__s")).select(*keep, "__s.segment", "__s.value")


def segment_bins(
    df: DataFrame,
    segments: Sequence[str],
    y: str = "y",
    p: str = "p",
    *,
    threshold: float = 0.5,
    n_bins: int = 10,
    strategy: str = "uniform",
    buckets: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """Sums per (segment, value, reliability bin) of all segments, from one read of the scored table.

    With `whole`, all rows together are one more group, with null segment and value and with all `n_bins` bins, and rows with an
    unusable target or score take scores that no model gives, by which `__bad`, `__not_finite` and `__outside` count them.

    Rows alike in score and in every segment become one before they are multiplied by the number of
    segments. The exchange of these sums also serves the size of the table and the score ranges. With uniform bins and several groups
    a row, they are multiplied only after they have been dealt by score range.
    """
    target = F.col(y).try_cast("double")
    usable = F.coalesce(target.isin(0.0, 1.0), F.lit(False))
    score = marked_score(usable, F.col(p).cast("double")) if whole else F.col(p)
    summed = df.groupBy(*(f"`{name}`" for name in segments), score.alias("__p")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.when(usable, target).otherwise(F.lit(0.0)).cast("int")).alias("__pos")
    )
    edges = range_edges(summed, buckets=buckets)
    if strategy == "uniform" and len(segments) + whole > 1:
        _check_names(segments)
        types = dict(summed.dtypes)
        values = [shown_value(f"`{name}`", types[name]) for name in segments] + [F.lit(None).cast("string")] * whole
        groups = F.array(*(F.struct(F.lit(i).alias("__s"), value.alias("__v")) for i, value in enumerate(values)))
        is_segment = F.col("__s") < len(segments)
        binned = ranked_bins_of_groups(
            summed, segments, groups, threshold=threshold, n_bins=n_bins, adaptive=is_segment if whole else True, edges=edges
        )
        name = F.get(F.array(*(F.lit(name) for name in segments)).cast("array<string>"), F.col("__s"))
        return binned.select(name.alias("segment"), F.col("__v").alias("value"), *[c for c in binned.columns if c not in ("__s", "__v")])
    long = unpivot_segments(summed, segments, ["__p", "__n", "__pos"], whole=whole)
    return ranked_bins(
        long.withColumnRenamed("__pos", "__y"), ["segment", "value"], threshold=threshold, n_bins=n_bins, strategy=strategy,
        adaptive=F.col("__group.segment").isNotNull() if whole else True, edges=edges,
    )


def _by_segment(binned: DataFrame, *, min_samples: int, threshold: float, include_small: bool = True) -> DataFrame:
    full = fold_bins(binned, ["segment", "value"], threshold, ranking=True)
    small = F.col("sample_count") < min_samples
    kept = [c for c in METRIC_COLUMNS if c not in ("sample_count", "positive_count")]
    reason = F.when(small, F.lit(fv.SMALL_GROUP_REASON.format(min_samples)))
    out = full.select(
        "segment", "value", "sample_count", "positive_count", reason.alias("skipped_reason"),
        *[F.when(~small, F.col(c)).alias(c) for c in kept],
    )
    return out if include_small else out.where(F.col("skipped_reason").isNull())


def subgroup_metrics(
    df: DataFrame,
    segments: Sequence[str],
    y: str = "y",
    p: str = "p",
    *,
    min_samples: int = 50,
    include_small: bool = True,
    threshold: float = 0.5,
    n_bins: int = 10,
    strategy: str = "uniform",
    buckets: int | None = None,
    check_size: bool = True,
) -> DataFrame:
    """Metrics of every value of every segment; small groups carry a skip reason.

    Bins shrink with the group: min(n_bins, max(2, rows // 10)). Whether there are `min_samples` rows at all
    is seen from as many rows; everything else comes from one read of the table.
    """
    if min_samples < 1 or (check_size and df.limit(min_samples).count() < min_samples):
        raise ValueError(fv.MIN_SAMPLES_ERROR)
    binned = segment_bins(df, segments, y, p, threshold=threshold, n_bins=n_bins, strategy=strategy, buckets=buckets)
    return _by_segment(binned, min_samples=min_samples, threshold=threshold, include_small=include_small)


def standard_segments(
    df: DataFrame,
    p: str = "p",
    *,
    context_class: str = "division",
    min_history: str = "feature_min_prior_fights",
    title: str | None = "is_title_bout",
) -> tuple[DataFrame, list[str]]:
    """The seven standard segment columns (six without a title flag)."""
    yes_no = lambda cond: F.when(cond, F.lit("yes")).otherwise(F.lit("no"))
    history = F.col(min_history)
    values = [
        F.col(context_class).cast("string"), yes_no(history >= 1), yes_no(history == 0), yes_no(history >= 3), experience_band(history), probability_band(p),
    ]
    if title is not None and title in df.columns:
        values.append(yes_no(F.col(title).cast("double") >= 0.5))
    columns = dict(zip(fv.STANDARD_SEGMENTS, values))
    return df.withColumns(columns), list(columns)


def rename_segments(result: DataFrame) -> DataFrame:
    """Report the class segment under its contract name."""
    return result.withColumn("segment", F.regexp_replace("segment", "^seg_", ""))


def evaluation_report(
    df: DataFrame,
    *,
    model_name: str,
    split_name: str,
    y: str = "y",
    p: str = "p",
    segments: Sequence[str] = (),
    min_samples: int = 50,
    threshold: float = 0.5,
    n_bins: int = 10,
    strategy: str = "uniform",
    notes: Sequence[str] = (),
    metadata: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """Report tables `metrics`, `bins`, `subgroups` and `notes`, each keyed by model and split.

    The scored table is read once. What all tables share is a row per segment value and bin (`sums`, persisted: release it by
    `report["sums"].unpersist()`). Its row of the whole table also tells whether the scored rows are usable.
    """
    if not model_name.strip() or not split_name.strip():
        raise ValueError("model_name and split_name must not be empty.")
    spark = df.sparkSession
    sums = segment_bins(df, segments, y, p, threshold=threshold, n_bins=n_bins, strategy=strategy, whole=True).persist()
    whole = sums.where(F.col("segment").isNull())
    names = {"__n": "row_count", "__bad": "bad_target", "__not_finite": "non_finite_probability", "__outside": "outside_unit_interval"}
    found = whole.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in names.items())).first().asDict()
    raise_findings(found)
    if segments and not 1 <= min_samples <= found["row_count"]:
        raise ValueError(fv.MIN_SAMPLES_ERROR)
    tagged = lambda frame: frame.select(
        F.lit(model_name).alias("model_name"), F.lit(split_name).alias("split_name"), "*"
    )
    report = {
        "sums": sums,
        "metrics": tagged(fold_bins(whole, [], threshold, ranking=True)),
        "bins": tagged(shown_bins(whole)),
    }
    if segments:
        of_values = sums.where(F.col("segment").isNotNull())
        report["subgroups"] = tagged(rename_segments(_by_segment(of_values, min_samples=min_samples, threshold=threshold)))
    lines = [("note", str(i), str(text)) for i, text in enumerate(notes)]
    lines += [("metadata", str(k), str(v)) for k, v in sorted((metadata or {}).items(), key=lambda kv: str(kv[0]))]
    lines += [("setting", "bin_strategy", strategy), ("setting", "n_bins", str(n_bins))]
    report["notes"] = tagged(spark.createDataFrame(lines, "kind string, name string, text string"))
    return report
