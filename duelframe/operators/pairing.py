"""Pairwise feature rows, generated as SQL expressions over two snapshot structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import blank_to_null, sql_array, sql_text

_INF = "double('Infinity')"


def _finite(value: str, default: float | None = None) -> str:
    """Finite value or null, or the default; NaN sorts above infinity, so one test does."""
    kept = f"CASE WHEN abs({value}) < {_INF} THEN {value} END"
    return f"({kept})" if default is None else f"coalesce({kept}, {default}D)"


class Side:
    """Reader of one side's numeric fields; a field the table lacks reads as null."""

    def __init__(self, struct: str, available: Sequence[str]) -> None:
        self.struct, self.fields = struct, set(available)

    def raw(self, name: str) -> str:
        return f"CAST({self.struct}.`{name}` AS DOUBLE)" if name in self.fields else "CAST(NULL AS DOUBLE)"

    def number(self, name: str, default: float | None = None) -> str:
        return _finite(self.raw(name), default)

    def history(self) -> str:
        return f"bround({self.number('feature_prior_fights', 0.0)}, 0)"

    def text(self, name: str) -> Column:
        return F.col(f"{self.struct}.`{name}`").cast("string") if name in self.fields else F.lit(None).cast("string")


def shared_sql(a: Side, b: Side, *, pounds: str, womens: str, catch: str, same_stance: str) -> dict[str, str]:
    """The 14 features that do not depend on who comes first."""
    pa, pb = a.history(), b.history()
    flag = lambda condition: f"CASE WHEN {condition} THEN 1D ELSE 0D END"
    either = lambda name: f"greatest({a.number(name, 1.0)}, {b.number(name, 1.0)})"
    minutes, fights, rating = "feature_career_minutes", "feature_division_elo_fights", "feature_elo_global"
    values = (
        f"CAST({pounds} AS DOUBLE)",
        flag(womens),
        flag(catch),
        f"least({pa}, {pb})",
        f"({pa} + {pb})",
        f"log1p({a.number(minutes, 0.0)} + {b.number(minutes, 0.0)})",
        flag(f"{pa} = 0 AND {pb} = 0"),
        flag(f"({pa} = 0) <> ({pb} = 0)"),
        flag(same_stance),
        either("feature_age_missing"),
        either("feature_height_missing"),
        either("feature_reach_missing"),
        f"least({a.number(fights, 0.0)}, {b.number(fights, 0.0)})",
        f"(({a.number(rating)} + {b.number(rating)}) / 2D)",
    )
    return dict(zip(fv.SHARED_FEATURES, values))


def difference_sql(a: Side, b: Side, name: str) -> str:
    """First minus second of one stored feature; null when either is unusable."""
    stored = "feature_" + name[len(fv.DIFFERENCE_PREFIX):]
    return f"({a.number(stored)} - {b.number(stored)})"


def with_feature_rows(
    df: DataFrame,
    names: Sequence[str],
    fields: Sequence[str],
    *,
    a: str = "a",
    b: str = "b",
    pounds: str = "class_pounds",
    womens: str = "class_womens",
    catch: str = "class_catch",
    stance: str = "stance",
    extra: str | None = "extra",
    ab: str = "x_ab",
    ba: str = "x_ba",
    ascii_only: bool = False,
) -> DataFrame:
    """Adds both orientations as arrays in the saved feature order.

    A feature is a difference, else a shared one, else taken from the request's
    map. Swapping the sides negates the differences and changes nothing else, so
    the second row is derived from the first.
    """
    from duelframe.operators.context_class import known_stance

    left, right = Side(a, fields), Side(b, fields)
    same = "false"
    if stance in fields and "feature_same_known_stance" in names:
        stances = [
            known_stance(F.expr(side.raw("feature_stance_missing")), side.text(stance), ascii_only=ascii_only) for side in (left, right)
        ]
        df = df.withColumn("__same_stance", F.coalesce(stances[0] == stances[1], F.lit(False)))
        same = "__same_stance"
    shared = shared_sql(left, right, pounds=pounds, womens=womens, catch=catch, same_stance=same)
    values, swapped = [], []
    for i, name in enumerate(names):
        if name.startswith(fv.DIFFERENCE_PREFIX):
            values.append(difference_sql(left, right, name))
            swapped.append(f"0D - get({ab}, {i})")
            continue
        if name in shared:
            values.append(shared[name])
        elif extra is not None:
            values.append(f"CAST(try_element_at(`{extra}`, {sql_text(name)}) AS DOUBLE)")
        else:
            values.append("CAST(NULL AS DOUBLE)")
        swapped.append(f"get({ab}, {i})")
    framed = df.withColumn(ab, F.expr(f"array({', '.join(values)})"))
    return framed.withColumn(ba, F.expr(f"array({', '.join(swapped)})")).drop("__same_stance")


def feature_error(names: Sequence[str], row: str = "x_ab") -> Column:
    """Error naming the first feature of a row array that is missing or not finite."""
    position = f"array_position(transform({row}, v -> coalesce(abs(v) < {_INF}, false)), false)"
    return F.expr(f"CASE WHEN {position} > 0 THEN concat('feature_unusable:', element_at({sql_array(names)}, CAST({position} AS INT))) END")


def history_error(a: Side, b: Side, *, needs_rating: bool) -> Column:
    """Errors the shared features raise before any feature is looked at."""
    minutes, rating = "feature_career_minutes", "feature_elo_global"
    text = f"""CASE WHEN {a.history()} < 0 OR {b.history()} < 0 THEN 'negative_history'
        WHEN {a.number(minutes, 0.0)} < 0 OR {b.number(minutes, 0.0)} < 0 THEN 'negative_minutes'"""
    if needs_rating:
        text += f" WHEN {a.number(rating)} IS NULL OR {b.number(rating)} IS NULL THEN 'rating_missing'"
    return F.expr(text + " END")


def orientation_rows(df: DataFrame, keep: Sequence[str], ab: str, ba: str, names: Sequence[str]) -> DataFrame:
    """Two rows per request, one per orientation, from the two row arrays. No join."""
    pair = F.array(
        F.struct(F.lit("ab").alias("orientation"), F.col(ab).alias("x")),
        F.struct(F.lit("ba").alias("orientation"), F.col(ba).alias("x")),
    )
    long = df.select(*keep, F.explode(pair).alias("o"))
    return long.select(*keep, "o.orientation", *[F.get("o.x", F.lit(i)).alias(n) for i, n in enumerate(names)])


RANGE_HITS = "array<struct<feature:string,training_min:double,training_max:double,a_vs_b:double,b_vs_a:double>>"


def out_of_range(names: Sequence[str], ranges: dict[str, tuple[float, float]], ab: str = "x_ab", ba: str = "x_ba") -> Column:
    """Features strictly outside the training range in either orientation.

    The ranges are a constant array (one entry per feature), so the plan stays the
    same size however many features there are.
    """
    rows = [
        f"named_struct('f', {sql_text(n)}, 'i', {i}, 'lo', {float(ranges[n][0])!r}D, 'hi', {float(ranges[n][1])!r}D)"
        for i, n in enumerate(names)
        if n in ranges
    ]
    if not rows:
        return F.expr(f"CAST(array() AS {RANGE_HITS})")
    outside = lambda x: f"CASE WHEN get({x}, r.i) < r.lo OR get({x}, r.i) > r.hi THEN get({x}, r.i) END"
    hit = f"named_struct('feature', r.f, 'training_min', r.lo, 'training_max', r.hi, 'a_vs_b', {outside(ab)}, 'b_vs_a', {outside(ba)})"
    return F.expr(f"filter(transform(array({', '.join(rows)}), r -> {hit}), h -> h.a_vs_b IS NOT NULL OR h.b_vs_a IS NOT NULL)")


def ordered_distinct(reasons: Sequence[Column]) -> Column:
    """Trimmed, non-empty, distinct texts in first-seen order."""
    return F.array_distinct(F.filter(F.array(*[blank_to_null(r) for r in reasons]), lambda r: r.isNotNull()))
