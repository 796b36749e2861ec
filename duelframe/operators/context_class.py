"""Context class of a matchup: resolution, inference and state guard.

The class table has 13 rows and 35 aliases, so both are constant maps in the plan
and no join is needed. Steps build on named columns, so a cleaned label is computed
once however many rules read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import blank_to_null, class_label, folded_case, lookup, sql_text, strip

_CODES = [code for code, _, _, _ in fv.CONTEXT_CLASSES]


def _class_table() -> str:
    """Code -> (pounds, womens, catch) as a SQL map."""
    rows = []
    for code, pounds, womens, catch in fv.CONTEXT_CLASSES:
        weight = "CAST(NULL AS DOUBLE)" if pounds is None else f"{pounds}D"
        rows.append(f"{sql_text(code)}, named_struct('pounds', {weight}, 'womens', {womens}, 'catch', {catch})")
    return f"map({', '.join(rows)})"


def class_code(label: Column, *, ascii_only: bool = False) -> Column:
    """Code of a code or label, null when unknown. With `ascii_only`, labels beyond ASCII are not case-folded."""
    direct = F.upper(strip(label))
    return F.when(direct.isin(*_CODES), direct).otherwise(lookup(fv.CONTEXT_ALIASES, class_label(label, ascii_only=ascii_only, for_lookup=True)))


def with_class(
    df: DataFrame,
    *,
    label: str = "division",
    pounds: str = "division_lbs",
    womens: str = "is_womens",
    catch: str = "is_catch_weight",
    prefix: str = "class_",
    ascii_only: bool = False,
) -> DataFrame:
    """Adds class_code, class_pounds, class_womens, class_catch, class_supported and class_error.

    An unknown label, or none at all, is accepted as unsupported when weight and
    gender are both given; otherwise conflicting context becomes an error code.
    """
    given = F.col(label)
    staged = df.withColumn("__code", F.when(given.isNotNull() & (given != ""), class_code(given, ascii_only=ascii_only)))
    staged = staged.withColumn("__base", F.expr(f"try_element_at({_class_table()}, coalesce(__code, ''))"))
    lbs = f"CAST(`{pounds}` AS DOUBLE)"
    present = f"`{label}` IS NOT NULL AND `{label}` <> ''"
    custom = f"(__code IS NULL AND {lbs} IS NOT NULL AND `{womens}` IS NOT NULL)"
    fields = {
        "code": f"CASE WHEN __code IS NOT NULL THEN __code WHEN {present} THEN __stripped ELSE {sql_text(fv.UNSPECIFIED_CLASS)} END",
        "pounds": f"coalesce({lbs}, __base.pounds)",
        "womens": f"CASE WHEN __code IS NOT NULL THEN __base.womens ELSE `{womens}` END",
        "catch": f"CASE WHEN __code IS NOT NULL THEN __base.catch ELSE coalesce(`{catch}`, false) END",
        "supported": "__code IS NOT NULL",
        "error": f"""CASE WHEN __code IS NULL AND NOT {custom} AND {present} THEN 'class_unsupported'
            WHEN __code IS NULL AND NOT {custom} THEN 'class_required'
            WHEN {lbs} IS NOT NULL AND NOT coalesce(abs({lbs}) < double('Infinity'), false) THEN 'class_weight_invalid'
            WHEN {custom} THEN NULL
            WHEN coalesce({lbs}, __base.pounds) IS NULL THEN 'class_weight_required'
            WHEN abs({lbs} - __base.pounds) > 1e-9D THEN 'class_weight_conflict'
            WHEN `{womens}` <> __base.womens THEN 'class_womens_conflict'
            WHEN `{catch}` <> __base.catch THEN 'class_catch_conflict' END""",
    }
    staged = staged.withColumn("__stripped", strip(label))
    return staged.withColumns({prefix + name: F.expr(text) for name, text in fields.items()}).drop("__code", "__base", "__stripped")


def snapshot_class(label: Column, *, ascii_only: bool = False) -> Column:
    """Class code stored in a snapshot; blank, UNKNOWN and OPEN count as none."""
    raw = blank_to_null(label)
    return F.when(~F.upper(raw).isin(*fv.UNUSABLE_CLASSES), class_code(raw, ascii_only=ascii_only))


def inferred_class(first: Column, second: Column) -> Column:
    """Label both snapshots agree on, null otherwise."""
    a, b = blank_to_null(first), blank_to_null(second)
    return F.when((a == b) & ~a.isin(*fv.UNUSABLE_CLASSES), a)


def uses_class_state(features: Sequence[str]) -> bool:
    return any(token in name for name in features for token in fv.CLASS_STATE_TOKENS)


def class_state_error(history: Column, stored: Column, code: Column) -> Column:
    """Error when an entity with history has no state in the requested class.

    `stored` is the class code kept in the snapshot (see `snapshot_class`).
    """
    return (
        F.when(history < 0, F.lit("negative_history"))
        .when(history == 0, F.lit(None))
        .when(stored.isNull(), F.lit("class_state_missing"))
        .when(stored != code, F.lit("class_state_mismatch"))
    )


def supported_classes(train: DataFrame, column: str = "division") -> DataFrame:
    """Distinct classes of the training rows that scoring supports."""
    code = F.col(column).cast("string")
    known = code.startswith(fv.SUPPORTED_CLASS_PREFIXES[0]) | code.startswith(fv.SUPPORTED_CLASS_PREFIXES[1]) | (code == "CATCH")
    return train.where(known).select(code.alias("context_class")).distinct()


def known_stance(missing_flag: Column, stance: Column, *, ascii_only: bool = False) -> Column:
    """Case-folded stance text, null when flagged missing or not a stance."""
    word = folded_case(blank_to_null(stance), ascii_only=ascii_only)
    flag = F.when(F.abs(missing_flag) < float("inf"), missing_flag)
    return F.when((F.coalesce(flag, F.lit(1.0)) < 0.5) & ~word.isin(*fv.UNKNOWN_STANCES), word)
