"""How well a matchup is covered by the training data: score, tier and warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import sql_text


@dataclass(frozen=True)
class SupportPolicy:
    """Thresholds of the grading."""

    limited_history: int = 3
    stale_snapshot_days: int = 180
    stale_entity_days: int = 1_095
    disagreement: float = 0.10

    def __post_init__(self) -> None:
        if self.limited_history < 0:
            raise ValueError("limited_history cannot be negative")
        if self.stale_snapshot_days < 0 or self.stale_entity_days < 0:
            raise ValueError("staleness thresholds cannot be negative")
        if not 0.0 <= self.disagreement <= 1.0:
            raise ValueError("disagreement must be between 0 and 1")

    @property
    def critical(self) -> float:
        return max(0.20, min(1.0, self.disagreement * 2.0))


def _steps(value: str, results: list[str]) -> str:
    """CASE over the cutoff steps."""
    text = "CASE"
    for (days, _, _), result in zip(fv.CUTOFF_STEPS[:-1], results):
        text += f" WHEN {value} <= {days} THEN {result}"
    return f"{text} ELSE {results[-1]} END"


def with_support_grade(
    df: DataFrame,
    *,
    prior_a: str = "prior_a",
    prior_b: str = "prior_b",
    disagreement: str = "orientation_disagreement",
    snapshot_age_a: str = "a.snapshot_age",
    snapshot_age_b: str = "b.snapshot_age",
    layoff_a: str = "a.layoff_days",
    layoff_b: str = "b.layoff_days",
    after_cutoff: str = "days_after_cutoff",
    out_of_range: str = "outside",
    unsupported: str = "reasons",
    policy: SupportPolicy = SupportPolicy(),
) -> DataFrame:
    """Adds `confidence_score`, `confidence_tier` and `warnings`; arguments are SQL expressions.

    Penalties come off one after the other in a fixed order, which keeps the double
    arithmetic of the score reproducible. Warnings follow the same order.
    """
    # greatest() skips nulls, so one known layoff is enough
    facts = {
        "__new": f"CAST({prior_a} = 0 AS INT) + CAST({prior_b} = 0 AS INT)",
        "__few": f"least({prior_a}, {prior_b}) < {policy.limited_history}",
        "__age_a": f"greatest(0, {snapshot_age_a})",
        "__age_b": f"greatest(0, {snapshot_age_b})",
        "__idle": f"coalesce(greatest({layoff_a}, {layoff_b}) > {policy.stale_entity_days}, false)",
        "__split": f"CASE WHEN {disagreement} >= {policy.critical}D THEN 2 WHEN {disagreement} >= {policy.disagreement}D THEN 1 ELSE 0 END",
        "__out": f"size({out_of_range})",
        "__why": f"size({unsupported})",
    }
    oldest = "greatest(__age_a, __age_b)"
    stale = f"{oldest} > {policy.stale_snapshot_days}"
    late = f"{after_cutoff} > 0"
    penalties = (
        f"CASE __new WHEN 2 THEN {fv.PENALTY_BOTH_DEBUT}D WHEN 1 THEN {fv.PENALTY_ONE_DEBUT}D ELSE 0D END",
        f"CASE WHEN __few THEN {fv.PENALTY_LIMITED}D ELSE 0D END",
        f"CASE WHEN NOT ({stale}) THEN 0D WHEN {oldest} <= {fv.VERY_STALE_DAYS} THEN {fv.PENALTY_STALE}D ELSE {fv.PENALTY_VERY_STALE}D END",
        f"CASE WHEN __idle THEN {fv.PENALTY_LAYOFF}D ELSE 0D END",
        f"CASE WHEN {late} THEN {_steps(after_cutoff, [f'{p}D' for _, p, _ in fv.CUTOFF_STEPS])} ELSE 0D END",
        f"CASE __split WHEN 2 THEN {fv.PENALTY_DISAGREE_CRITICAL}D WHEN 1 THEN {fv.PENALTY_DISAGREE}D ELSE 0D END",
        f"CASE WHEN __out > 0 THEN least({fv.RANGE_CAP}D, {fv.RANGE_BASE}D + {fv.RANGE_STEP}D * __out) ELSE 0D END",
        f"CASE WHEN __why > 0 THEN least({fv.UNSUPPORTED_CAP}D, {fv.UNSUPPORTED_BASE}D + {fv.UNSUPPORTED_STEP}D * (__why - 1)) ELSE 0D END",
    )
    score = "least(1D, greatest(0D, 1D - " + " - ".join(penalties) + "))"
    tier = f"CASE WHEN __why > 0 THEN '{fv.TIER_STEPS[-1][0]}'"
    for name, floor in fv.TIER_STEPS[:-1]:
        tier += f" WHEN __score >= {floor}D THEN '{name}'"
    tier += f" ELSE '{fv.TIER_STEPS[-1][0]}' END"

    text = lambda value: f"CAST({value} AS STRING)"
    pairs = lambda **kv: "map(" + ", ".join(f"'{k}', {text(v)}" for k, v in kv.items()) + ")"
    empty = "CAST(map() AS MAP<STRING, STRING>)"

    def warning(condition: str, code: str, severity: str, message: str, details: str) -> str:
        return (
            f"CASE WHEN {condition} THEN named_struct('code', '{code}', 'severity', {severity}, "
            f"'message', {message}, 'details', {details}) END"
        )

    stale_map = f"CASE WHEN {stale} THEN " + pairs(
        fighter_a_snapshot_age_days="__age_a", fighter_b_snapshot_age_days="__age_b", snapshot_threshold_days=policy.stale_snapshot_days
    ) + f" ELSE {empty} END"
    idle_map = "CASE WHEN __idle THEN " + pairs(
        fighter_a_layoff_days=layoff_a, fighter_b_layoff_days=layoff_b, layoff_threshold_days=policy.stale_entity_days
    ) + f" ELSE {empty} END"
    newcomers = f"concat_ws(',', CASE WHEN {prior_a} = 0 THEN 'fighter_a' END, CASE WHEN {prior_b} = 0 THEN 'fighter_b' END)"
    range_map = (
        f"map_from_entries(transform({out_of_range}, h -> named_struct('key', h.feature, 'value', to_json(named_struct("
        "'training_min', h.training_min, 'training_max', h.training_max, 'a_vs_b', h.a_vs_b, 'b_vs_a', h.b_vs_a)))))"
    )
    listed = (
        warning(
            "__new > 0", "debut", "CASE __new WHEN 2 THEN 'critical' ELSE 'warning' END",
            f"CASE __new WHEN 2 THEN {sql_text(fv.MSG_DEBUT_BOTH)} ELSE {sql_text(fv.MSG_DEBUT_ONE)} END", pairs(fighters=newcomers),
        ),
        warning(
            "__few", "limited_history", "'warning'", sql_text(fv.MSG_LIMITED),
            pairs(
                fighter_a_prior_fights=f"CAST({prior_a} AS BIGINT)", fighter_b_prior_fights=f"CAST({prior_b} AS BIGINT)",
                threshold=policy.limited_history,
            ),
        ),
        warning(f"{stale} OR __idle", "stale", "'warning'", sql_text(fv.MSG_STALE), f"map_concat({stale_map}, {idle_map})"),
        warning(
            late, "after_cutoff", _steps(after_cutoff, [f"'{s}'" for _, _, s in fv.CUTOFF_STEPS]), sql_text(fv.MSG_CUTOFF),
            pairs(days_after_cutoff=after_cutoff, rolling_activity_note=sql_text(fv.MSG_CUTOFF_NOTE)),
        ),
        warning(
            "__split > 0", "orientation_disagreement", "CASE __split WHEN 2 THEN 'critical' ELSE 'warning' END", sql_text(fv.MSG_DISAGREE),
            pairs(absolute_disagreement=disagreement, warning_threshold=policy.disagreement, critical_threshold=policy.critical),
        ),
        warning(
            "__out > 0", "out_of_range", f"CASE WHEN __out >= {fv.RANGE_CRITICAL_COUNT} THEN 'critical' ELSE 'warning' END",
            sql_text(fv.MSG_RANGE), range_map,
        ),
        warning("__why > 0", "unsupported", "'critical'", sql_text(fv.MSG_UNSUPPORTED), pairs(reasons=f"array_join({unsupported}, '; ')")),
    )
    staged = df.withColumns({name: F.expr(value) for name, value in facts.items()})
    staged = staged.withColumn("__score", F.expr(score))
    staged = staged.withColumns(
        {
            "confidence_score": F.expr("round(__score, 6)"),
            "confidence_tier": F.expr(tier),
            "warnings": F.expr(f"filter(array({', '.join(listed)}), w -> w IS NOT NULL)"),
        }
    )
    return staged.drop("__score", *facts)
