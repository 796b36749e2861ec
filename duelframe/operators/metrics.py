"""Probability metrics: counts, losses, ranking, thresholds, reliability bins.

Two paths share one definition of every metric:

* `binary_metrics(..., ranking=False)` and `reliability_bins` need one pass with
  map-side sums; what is shuffled is at most bins x groups rows.
* With ranking (ROC-AUC, average precision, exact quantile edges) rows are first
  summed per distinct score, then prefix sums run inside score ranges. The ranges
  come from a sorted sample of the distinct scores, so no task gets more than its
  share of the scores whatever their distribution, and offsets between ranges are
  added from a table of one row per range and group. Results are exact, and the scored
  table is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.values import clip, is_finite, row_log_loss
from duelframe import fixed_values as fv
from duelframe.session import shuffle_width

_BUCKET = "__bucket"
_ONE = "__all"
_GROUP = "__group"
#: scores that stand for unusable rows where a report counts them: target not 0 or 1, score not finite, score outside [0, 1]
BAD_TARGET, NOT_FINITE, OUTSIDE = -1.0, -2.0, -3.0

METRIC_COLUMNS = (
    "sample_count", "positive_count", "prevalence", "log_loss", "brier_score", "roc_auc",
    "average_precision", "accuracy", "precision", "recall", "f1_score", "true_negative",
    "false_positive", "false_negative", "true_positive", "threshold",
    "expected_calibration_error", "maximum_calibration_error",
)


def _check_bins(n_bins: int, strategy: str) -> None:
    if not 2 <= n_bins <= 100:
        raise ValueError("n_bins must be in [2, 100].")
    if strategy not in ("uniform", "quantile"):
        raise ValueError("strategy must be 'uniform' or 'quantile'.")


def _grouped(scored: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Group columns as one struct, which is never null itself, so that null groups join like any other."""
    if not by:
        return scored, []
    rest = [c for c in scored.columns if c not in by]
    return scored.select(F.struct(*by).alias(_GROUP), *rest), [_GROUP]


def _ungrouped(by: list[str]) -> list[Column]:
    return [F.col(f"{_GROUP}.`{name}`").alias(name) for name in by]


def _check_threshold(threshold: float) -> None:
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must lie strictly between 0 and 1.")


def prediction_findings(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row counting what makes a scored table unusable."""
    target, prob = F.col(y).try_cast("double"), F.col(p).try_cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~F.coalesce(target.isin(0.0, 1.0), F.lit(False))).alias("bad_target"),
        F.count_if(~is_finite(prob)).alias("non_finite_probability"),
        F.count_if(is_finite(prob) & ~prob.between(0.0, 1.0)).alias("outside_unit_interval"),
    )


def marked_score(usable_target: Column, prob: Column) -> Column:
    """The score, or what stands for an unusable row."""
    return (
        F.when(~usable_target, F.lit(BAD_TARGET)).when(~is_finite(prob), F.lit(NOT_FINITE)).when(~prob.between(0.0, 1.0), F.lit(OUTSIDE)).otherwise(prob)
    )


def assert_predictions(df: DataFrame, y: str = "y", p: str = "p") -> None:
    raise_findings(prediction_findings(df, y, p).first().asDict())


def raise_findings(row: dict) -> None:
    """Raise for the first thing that makes a scored table unusable."""
    if not row["row_count"]:
        raise ValueError("scored table must not be empty.")
    if row["bad_target"]:
        raise ValueError("target must contain only 0 and 1.")
    if row["non_finite_probability"]:
        raise ValueError("probabilities must be finite.")
    if row["outside_unit_interval"]:
        raise ValueError("probabilities must lie in [0, 1].")


# --- reliability bins -------------------------------------------------------------


def uniform_bin(prob: Column, n_bins: Column | int) -> Column:
    """Right-open bin index on edges i * (1 / n); a score of 1 is in the last bin."""
    n = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    step = F.lit(1.0) / n
    guess = F.floor(prob * n)
    # the guess is off by at most one where i * (1 / n) is not exactly i / n
    exact = (
        guess
        - F.when(prob < guess * step, F.lit(1)).otherwise(F.lit(0))
        + F.when(prob >= (guess + 1) * step, F.lit(1)).otherwise(F.lit(0))
    )
    return F.greatest(F.lit(0), F.least(n - 1, exact)).cast("int")


def _uniform_edge(index: Column, n: Column) -> Column:
    return F.when(index >= n, F.lit(1.0)).otherwise(index * (F.lit(1.0) / n))


def _edge_bin(prob: Column, edges: Column) -> Column:
    """Number of interior edges at or below the score."""
    inner = F.slice(edges, 2, F.size(edges) - 2)
    return F.when(F.size(edges) <= 2, F.lit(0)).otherwise(
        F.size(F.filter(inner, lambda edge: edge <= prob))
    )


def reliability_bins(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    *,
    by: Sequence[str] = (),
    n_bins: int = 10,
    strategy: str = "uniform",
    buckets: int | None = None,
) -> DataFrame:
    """Non-empty bins with count, mean probability, observed rate and gap."""
    _check_bins(n_bins, strategy)
    by = list(by)
    scored = df.select(*by, F.col(y).cast("int").alias("__y"), F.col(p).alias("__p"))
    if strategy == "uniform":
        binned = (
            scored.withColumn("bin_index", uniform_bin(F.col("__p"), n_bins))
            .groupBy(*by, "bin_index")
            .agg(
                F.count(F.lit(1)).alias("count"),
                F.sum("__p").alias("__sum_p"),
                F.sum("__y").alias("__pos"),
            )
            .withColumn("lower_bound", _uniform_edge(F.col("bin_index"), F.lit(n_bins)))
            .withColumn("upper_bound", _uniform_edge(F.col("bin_index") + 1, F.lit(n_bins)))
        )
    else:
        packed, keys = _grouped(scored, by)
        ranked = _ranked_scores(packed, keys, n_bins=n_bins, strategy=strategy, adaptive=False, buckets=buckets)
        binned = (
            ranked.groupBy(*keys, "bin_index")
            .agg(
                F.sum("__n").alias("count"),
                F.sum(F.col("__p") * F.col("__n")).alias("__sum_p"),
                F.sum("__pos").alias("__pos"),
                F.min("lower_bound").alias("lower_bound"),
                F.max("upper_bound").alias("upper_bound"),
            )
            .select(*_ungrouped(by), "bin_index", "count", "__sum_p", "__pos", "lower_bound", "upper_bound")
        )
    return (
        binned.withColumn("mean_probability", F.col("__sum_p") / F.col("count"))
        .withColumn("observed_rate", F.col("__pos") / F.col("count"))
        .withColumn("absolute_gap", F.abs(F.col("mean_probability") - F.col("observed_rate")))
        .select(
            *by, "bin_index", "lower_bound", "upper_bound", "count",
            "mean_probability", "observed_rate", "absolute_gap",
        )
    )


def quantile_edges(
    df: DataFrame, p: str = "p", *, by: Sequence[str] = (), n_bins: int = 10, buckets: int | None = None
) -> DataFrame:
    """Exact quantile bin edges, distinct, with 0 and 1 at the ends."""
    _check_bins(n_bins, "quantile")
    scored = df.select(*by, F.lit(0).alias("__y"), F.col(p).alias("__p"))
    packed, keys = _grouped(scored, list(by))
    prefix = _prefix_rows(packed, keys, buckets)
    return _edges_from_prefix(prefix, keys, F.lit(n_bins)).select(*_ungrouped(list(by)), "edges")


def calibration_error(
    df: DataFrame, y: str = "y", p: str = "p", *, by: Sequence[str] = (), n_bins: int = 10,
    strategy: str = "uniform",
) -> DataFrame:
    """Count-weighted mean gap and largest gap over the reliability bins."""
    bins = reliability_bins(df, y, p, by=by, n_bins=n_bins, strategy=strategy)
    return bins.groupBy(*by).agg(
        (F.sum(F.col("count") * F.col("absolute_gap")) / F.sum("count")).alias("expected_calibration_error"),
        F.max("absolute_gap").alias("maximum_calibration_error"),
    )


# --- ranking: score ranges and prefix sums --------------------------------------------


#: score ranges are cut by the number of distinct scores, never by the width of a shuffle
_SCORES_A_RANGE = 20_000
_MOST_RANGES = 16_384
_SAMPLED_A_RANGE = 16


def range_edges(summed: DataFrame, *, rows: str = "__n", hits: str = "__pos", p: str = "__p", buckets: int | None = None) -> tuple[Column, int]:
    """Ascending score boundaries as a scalar subquery, and the most there can be.

    `summed` has one row for each distinct score and key. A sample of these rows by hash, sixteen a range at least, is sorted and cut into even
    parts: whoever computes it gets the same boundaries, whatever the order of rows, so all
    branches of a plan agree. The boundaries only balance the work. They are data, not part of the plan, and both subqueries
    read the exchange that the plan itself reads: each looks at counts and positives, so that no column is pruned from it.
    """
    if buckets is not None and buckets < 1:
        raise ValueError("buckets must be positive.")
    present = (F.col(rows) > 0) & (F.col(hits) >= 0)
    n = summed.agg(F.count_if(present).alias("n")).scalar()
    ranges = F.lit(buckets) if buckets else F.least(F.lit(_MOST_RANGES), F.ceil(F.col("n") / _SCORES_A_RANGE)).cast("int")
    step = F.greatest(F.lit(1), F.floor(n / ((buckets or _MOST_RANGES) * _SAMPLED_A_RANGE)))
    sampled = summed.where((F.pmod(F.xxhash64(p), step) < F.signum(rows)) & present)
    listed = sampled.agg(F.array_sort(F.collect_set(F.col(p).cast("double"))).alias("s")).withColumn("n", n).withColumn("ranges", ranges)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("ranges") - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / F.col("ranges")).cast("int")))
    edges = listed.select(F.when(F.col("ranges") > 1, F.array_distinct(cut)).otherwise(F.array().cast("array<double>")).alias("edges"))
    return edges.scalar(), (buckets or _MOST_RANGES)


def with_range(df: DataFrame, edges: tuple[Column, int]) -> DataFrame:
    """Adds the number of boundaries at or below the score, by binary search.

    A column for each step, because Spark compiles these, while a fold over the steps would be interpreted for every row. There
    are as many steps for few ranges as for many, so that the plan does not depend on them.
    """
    bounds, most = edges
    placed = df.withColumn("__edges", bounds).withColumn(_BUCKET, F.lit(0))
    for k in range(max(most, _MOST_RANGES).bit_length() - 1, -1, -1):
        at = F.col(_BUCKET)
        placed = placed.withColumn(_BUCKET, at + F.when(F.get(F.col("__edges"), at + ((1 << k) - 1)) <= F.col("__p"), F.lit(1 << k)).otherwise(F.lit(0)))
    return placed.drop("__edges")


def _prefix_rows(
    scored: DataFrame, by: list[str], buckets: int | None, edges: tuple[Column, int] | None = None
) -> DataFrame:
    """Distinct scores per group with counts and exact counts of everything below.

    Rows may already be sums: then `__n` holds how many rows each stands for and
    `__y` their positives. The table is read once: the boundaries of the score
    ranges come from the sums per score.
    """
    rows = F.sum("__n") if "__n" in scored.columns else F.count(F.lit(1))
    keys = by or [_ONE]
    # stated here once, so that the join below adds no filter to one branch only and
    # both branches share one shuffle of the per-score sums
    base = scored if by else scored.withColumn(_ONE, F.lit(0))
    summed = base.groupBy(*keys, "__p").agg(rows.alias("__n"), F.sum("__y").alias("__pos"))
    totals_of_score = with_range(summed, edges or range_edges(summed, buckets=buckets))
    # a row per range and group, so this window stays small
    per_group = Window.partitionBy(*keys)
    below = per_group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals_of_score.groupBy(*keys, _BUCKET)
        .agg(F.sum("__n").alias("__bn"), F.sum("__pos").alias("__bpos"))
        # true of every row; it keeps both sums in branches that ask for one, so that all read the same exchange
        .where((F.col("__bn") > 0) & (F.coalesce("__bpos", F.lit(0)) >= 0))
        .select(
            *keys,
            _BUCKET,
            F.coalesce(F.sum("__bn").over(below), F.lit(0)).alias("__n_offset"),
            F.coalesce(F.sum("__bpos").over(below), F.lit(0)).alias("__pos_offset"),
            F.sum("__bn").over(per_group).alias("__total"),
            F.sum("__bpos").over(per_group).alias("__positives"),
        )
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals_of_score.withColumn("__n_in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .withColumn("__pos_in", F.coalesce(F.sum("__pos").over(inside), F.lit(0)))
        # the big side is already partitioned and sorted on these keys by its window
        .join(offsets.hint("merge"), [*keys, _BUCKET])
        .select(
            *keys, _BUCKET, "__p", "__n", "__pos", "__total", "__positives",
            (F.col("__n_offset") + F.col("__n_in")).alias("__n_below"),
            (F.col("__pos_offset") + F.col("__pos_in")).alias("__pos_below"),
        )
    )


def _edges_from_prefix(prefix: DataFrame, by: list[str], n_bins: Column) -> DataFrame:
    """Linear-interpolated quantiles picked out of the prefix counts by rank."""
    keys = by or [_ONE]
    wanted = prefix.withColumn("__bins", n_bins).select(
        *keys,
        "__p",
        F.explode(
            F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.col("__bins")),
                    lambda i: F.struct(
                        i.alias("i"),
                        ((F.col("__total") - 1) * _uniform_edge(i, F.col("__bins"))).alias("rank"),
                    ),
                ),
                lambda t: (F.floor(t["rank"]) < F.col("__n_below") + F.col("__n"))
                & (F.least(F.floor(t["rank"]) + 1, F.col("__total") - 1) >= F.col("__n_below")),
            )
        ).alias("__t"),
        "__n_below",
        "__n",
        "__total",
    )
    low_rank = F.floor(F.col("__t.rank"))
    high_rank = F.least(low_rank + 1, F.col("__total") - 1)
    holds = lambda rank: (rank >= F.col("__n_below")) & (rank < F.col("__n_below") + F.col("__n"))
    points = wanted.groupBy(*keys, F.col("__t.i").alias("__i")).agg(
        F.max(F.when(holds(low_rank), F.col("__p"))).alias("__a"),
        F.max(F.when(holds(high_rank), F.col("__p"))).alias("__b"),
        F.max(F.col("__t.rank") - low_rank).alias("__g"),
    )
    gap = F.col("__b") - F.col("__a")
    value = F.when(F.col("__g") >= 0.5, F.col("__b") - gap * (1.0 - F.col("__g"))).otherwise(
        F.col("__a") + gap * F.col("__g")
    )
    # at most 101 values per group
    edges = points.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("__e"))
    middle = F.slice(F.col("__e"), 2, F.size("__e") - 2)
    ends = F.array(F.lit(0.0), F.lit(1.0))
    return edges.select(
        *keys,
        F.when(F.size("__e") < 3, ends)
        .otherwise(F.concat(F.array(F.lit(0.0)), middle, F.array(F.lit(1.0))))
        .alias("edges"),
    )


def _bins_of_group(n_bins: int, adaptive: bool | Column) -> Column:
    """Number of bins, fewer for small groups where `adaptive` holds."""
    if adaptive is False:
        return F.lit(n_bins)
    tenth = F.floor(F.col("__total") / 10).cast("int")
    fitting = F.least(F.lit(n_bins), F.greatest(F.lit(2), tenth))
    return fitting if adaptive is True else F.when(adaptive, fitting).otherwise(F.lit(n_bins))


def _with_uniform_bins(prefix: DataFrame, bins: Column) -> DataFrame:
    return (
        prefix.withColumn("bin_index", uniform_bin(F.col("__p"), bins))
        .withColumn("lower_bound", _uniform_edge(F.col("bin_index"), bins))
        .withColumn("upper_bound", _uniform_edge(F.col("bin_index") + 1, bins))
    )


def _ranked_scores(
    scored: DataFrame, by: list[str], *, n_bins: int, strategy: str, adaptive: bool | Column, buckets: int | None,
    edges: tuple[Column, int] | None = None,
) -> DataFrame:
    """Prefix rows with the reliability bin of every distinct score."""
    keys = by or [_ONE]
    prefix = _prefix_rows(scored, by, buckets, edges)
    bins = _bins_of_group(n_bins, adaptive)
    if strategy == "uniform":
        return _with_uniform_bins(prefix, bins)
    # both branches look at positives and counts, so that no column is pruned and all read one exchange of the sums per score
    present = (F.col("__n") > 0) & (F.coalesce("__pos", F.lit(0)) >= 0)
    quantiles = _edges_from_prefix(prefix.where(present), by, bins)
    # edges go to one row per (group, range) first, so the big side keeps its partitioning
    ranges = prefix.groupBy(*keys, _BUCKET).agg(F.count_if(present).alias("__present")).where("__present > 0").drop("__present")
    per_range = ranges.join(quantiles, keys)
    return (
        prefix.join(per_range, [*keys, _BUCKET])
        .withColumn("bin_index", _edge_bin(F.col("__p"), F.col("edges")))
        .withColumn("lower_bound", F.get("edges", F.col("bin_index")))
        .withColumn("upper_bound", F.get("edges", F.col("bin_index") + 1))
        .drop("edges")
    )


# --- metrics ------------------------------------------------------------------------


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def fold_bins(binned: DataFrame, by: list[str], threshold: float, ranking: bool) -> DataFrame:
    gap = F.abs(F.col("__sum_p") / F.col("__n") - F.col("__pos") / F.col("__n"))
    sums = [
        F.sum("__n").alias("sample_count"),
        F.sum("__pos").alias("positive_count"),
        F.sum("__ll").alias("__ll"),
        F.sum("__sq").alias("__sq"),
        F.sum("__called").alias("__called"),
        F.sum("__tp").alias("true_positive"),
        F.sum(F.col("__n") * gap).alias("__gap"),
        F.max(gap).alias("maximum_calibration_error"),
    ]
    if ranking:
        sums += [F.sum("__auc").alias("__auc"), F.sum("__ap").alias("__ap")]
    folded = binned.groupBy(*by).agg(*sums) if by else binned.agg(*sums)
    n, pos, tp, called = (F.col(c) for c in ("sample_count", "positive_count", "true_positive", "__called"))
    both = (pos > 0) & (pos < n)
    none = F.lit(None).cast("double")
    auc = F.when(both, F.try_divide(F.col("__auc"), pos.cast("double") * (n - pos))) if ranking else none
    ap = F.when(both, F.try_divide(F.col("__ap"), pos.cast("double"))) if ranking else none
    out = folded.where(n > 0).select(
        *by,
        n,
        pos,
        (pos / n).alias("prevalence"),
        (F.col("__ll") / n).alias("log_loss"),
        (F.col("__sq") / n).alias("brier_score"),
        auc.alias("roc_auc"),
        ap.alias("average_precision"),
        ((tp + (n - pos) - (called - tp)) / n).alias("accuracy"),
        _ratio(tp, called).alias("precision"),
        _ratio(tp, pos).alias("recall"),
        _ratio(2 * tp, called + pos).alias("f1_score"),
        ((n - pos) - (called - tp)).alias("true_negative"),
        (called - tp).alias("false_positive"),
        (pos - tp).alias("false_negative"),
        tp,
        F.lit(float(threshold)).alias("threshold"),
        (F.col("__gap") / n).alias("expected_calibration_error"),
        "maximum_calibration_error",
    )
    return out.select(*by, *METRIC_COLUMNS)


def binary_metrics(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    *,
    by: Sequence[str] = (),
    threshold: float = 0.5,
    n_bins: int = 10,
    strategy: str = "uniform",
    ranking: bool = True,
    adaptive_bins: bool = False,
    buckets: int | None = None,
    edges: tuple[Column, int] | None = None,
    rows: str | None = None,
) -> DataFrame:
    """All 18 metrics, one row per group (one row when `by` is empty).

    Rows whose group is null are a group of their own. Without `ranking`, uniform bins are filled in
    one pass and the two ranking metrics stay null. With `rows`, every input row
    stands for that many rows and `y` is the number of positives among them.
    """
    _check_bins(n_bins, strategy)
    _check_threshold(threshold)
    by = list(by)
    scored = df.select(*by, F.col(y).cast("int").alias("__y"), F.col(p).alias("__p"))
    if rows is not None:
        if not ranking:
            raise ValueError("summed rows need the ranking path")
        scored = df.select(*by, F.col(y).alias("__y"), F.col(p).alias("__p"), F.col(rows).alias("__n"))
    prob = F.col("__p")
    called = F.when(prob >= threshold, F.lit(1)).otherwise(F.lit(0))
    if not ranking and strategy == "uniform" and not adaptive_bins:
        target = F.col("__y")
        binned = (
            scored.withColumn("bin_index", uniform_bin(prob, n_bins))
            .groupBy(*by, "bin_index")
            .agg(
                F.count(F.lit(1)).alias("__n"),
                F.sum("__y").alias("__pos"),
                F.sum("__p").alias("__sum_p"),
                F.sum(row_log_loss(target, prob)).alias("__ll"),
                F.sum((prob - target) * (prob - target)).alias("__sq"),
                F.sum(called).alias("__called"),
                F.sum(called * target).alias("__tp"),
            )
        )
        return fold_bins(binned, by, threshold, ranking=False)

    binned = ranked_bins(scored, by, threshold=threshold, n_bins=n_bins, strategy=strategy, adaptive=adaptive_bins, buckets=buckets, edges=edges)
    return fold_bins(binned, by, threshold, ranking=True)


def ranked_bins(
    scored: DataFrame, by: list[str], *, threshold: float, n_bins: int, strategy: str, adaptive: bool | Column = False,
    buckets: int | None = None, edges: tuple[Column, int] | None = None,
) -> DataFrame:
    """Per group and reliability bin, all sums from which metrics, bins and checks of a report follow.

    `scored` has the columns of `by`, `__y`, `__p` and, where rows are sums already, `__n`.
    """
    packed, keys = _grouped(scored, by)
    ranked = _ranked_scores(packed, keys, n_bins=n_bins, strategy=strategy, adaptive=adaptive, buckets=buckets, edges=edges)
    n, pos = F.col("__n"), F.col("__pos")
    neg_below = F.col("__n_below") - F.col("__pos_below")
    tp_at = F.col("__positives") - F.col("__pos_below")
    called_at = F.col("__total") - F.col("__n_below")
    binned = _bin_sums(ranked, keys, threshold, auc=pos * (neg_below + (n - pos) / 2.0), ap=pos * (tp_at / called_at))
    return binned.select(*_ungrouped(by), *[c for c in binned.columns if c not in (_GROUP, _ONE)])


def ranked_bins_of_groups(
    summed: DataFrame, columns: Sequence[str], groups: Column, *, threshold: float, n_bins: int, adaptive: bool | Column, edges: tuple[Column, int]
) -> DataFrame:
    """`ranked_bins` with uniform bins for rows that are in several groups at once, keyed by the fields `__s` and `__v` of `groups`.

    `summed` has a row per distinct `columns` and score. Rows are dealt by score range alone, once, and multiplied by their
    groups inside the tasks; what is above a range comes along as one row a group that sorts before the range's scores, so nothing is
    joined. Rows of one group alike in score stay apart: the frame of the window counts ties.
    """
    placed = with_range(summed.select(*(f"`{c}`" for c in columns), "__p", "__n", "__pos"), edges)
    keys = ["__s", "__v"]
    cells = (
        placed.groupBy(*(f"`{c}`" for c in columns), _BUCKET)
        .agg(F.sum("__n").alias("__n"), F.sum("__pos").alias("__pos"))
        .select(_BUCKET, "__n", "__pos", F.explode(groups).alias("__g"))
        .groupBy("__g.__s", "__g.__v", _BUCKET)
        .agg(F.sum("__n").alias("__bn"), F.sum("__pos").alias("__bpos"))
    )
    # a row per range and group, so this window stays small
    per_group = Window.partitionBy(*keys)
    above = per_group.orderBy(F.desc(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        _BUCKET,
        F.array(F.struct(*keys)).alias("__groups"),
        # sorts before every score
        F.lit(float("nan")).alias("__p"),
        F.coalesce(F.sum("__bn").over(above), F.lit(0)).alias("__n"),
        F.coalesce(F.sum("__bpos").over(above), F.lit(0)).alias("__pos"),
        F.sum("__bn").over(per_group).alias("__total"),
        F.sum("__bpos").over(per_group).alias("__positives"),
    )
    # the number is given, so that small shuffled rows are not put together into tasks that are large once multiplied
    dealt = placed.withColumn("__p", F.col("__p").cast("double")).unionByName(offsets, allowMissingColumns=True).repartition(4 * shuffle_width(summed.sparkSession), _BUCKET)
    carried = [_BUCKET, "__p", "__n", "__pos", "__total", "__positives"]
    rows = dealt.select(*carried, F.col("__groups").isNull().alias("__scored"), F.explode(F.coalesce("__groups", groups)).alias("__g")).select(
        *carried, "__scored", "__g.*"
    )
    # most comparisons of the sort are between rows of one range and group, so it has few keys: range and segment are whole in the
    # first one, which sorts fast; the value keeps equal hashes apart, and the range is there because rows are dealt by it
    cell = F.shiftleft(F.col(_BUCKET).cast("bigint"), 48) + F.shiftleft(F.col("__s").cast("bigint"), 32) + F.hash("__v")
    upto = Window.partitionBy("__cell", _BUCKET, "__v").orderBy(F.desc("__p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = {"__n_from": F.sum("__n"), "__pos_from": F.sum("__pos"), "__total": F.max("__total"), "__positives": F.max("__positives")}
    ranked = rows.withColumn("__cell", cell).withColumns({name: value.over(upto) for name, value in counted.items()}).where("__scored")
    n, pos, n_from, pos_from = (F.col(c).cast("double") for c in ("__n", "__pos", "__n_from", "__pos_from"))
    # pairs of a positive and a negative are in order, reversed or tied: what is in order and half the ties, from counts that include ties
    auc = (pos * (F.col("__total") - F.col("__positives")) - pos * (n_from - pos_from) + (n - pos) * pos_from) / 2.0
    return _bin_sums(_with_uniform_bins(ranked, _bins_of_group(n_bins, adaptive)), keys, threshold, auc=auc, ap=pos * (pos_from / n_from))


def _bin_sums(ranked: DataFrame, keys: list[str], threshold: float, *, auc: Column, ap: Column) -> DataFrame:
    """Sums per group and bin; `auc` and `ap` are what a row adds to the two ranking metrics."""
    prob, n, pos = F.col("__p"), F.col("__n"), F.col("__pos")
    called = F.when(prob >= threshold, F.lit(1)).otherwise(F.lit(0))
    neg = n - pos
    safe = clip(prob, fv.LOG_LOSS_EPSILON, 1.0 - fv.LOG_LOSS_EPSILON)
    return ranked.groupBy(*keys, "bin_index").agg(
        F.min("lower_bound").alias("lower_bound"),
        F.max("upper_bound").alias("upper_bound"),
        F.sum(n).alias("__n"),
        F.sum(pos).alias("__pos"),
        F.sum(prob * n).alias("__sum_p"),
        F.sum(-(pos * F.log(safe) + neg * F.log(1.0 - safe))).alias("__ll"),
        F.sum(pos * (1.0 - prob) * (1.0 - prob) + neg * prob * prob).alias("__sq"),
        F.sum(called * n).alias("__called"),
        F.sum(called * pos).alias("__tp"),
        F.sum(auc).alias("__auc"),
        F.sum(ap).alias("__ap"),
        *(F.sum(F.when(prob == mark, n).otherwise(F.lit(0))).alias(name) for name, mark in (("__bad", BAD_TARGET), ("__not_finite", NOT_FINITE), ("__outside", OUTSIDE))),
    )


def shown_bins(binned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reliability bins out of sums per group and bin."""
    mean, rate = F.col("__sum_p") / F.col("__n"), F.col("__pos") / F.col("__n")
    return binned.select(
        *by, "bin_index", "lower_bound", "upper_bound", F.col("__n").alias("count"), mean.alias("mean_probability"), rate.alias("observed_rate"),
        F.abs(mean - rate).alias("absolute_gap"),
    )
