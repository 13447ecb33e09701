"""Scores and states that follow from a few numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of issues by severity, and of the parts of a score.
SEVERITY_WEIGHTS = {"info": 0.0, "warning": 0.5, "error": 2.0, "critical": 5.0}
FRESHNESS_SCORES = {"fresh": 100.0, "stale": 50.0, "critical": 0.0, "unknown": 50.0, "disabled": 75.0}
LOWER_IS_BETTER = ("latency", "error_rate", "freshness")


def rounded(value: Column, digits: int) -> Column:
    """A double to so many digits, halves away from zero: what prints as 25.849999999999998, as 77.55 / 3 does, is 25.9 and not 25.8."""
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale


def quality_score(weighted_issues: Column, rows: Column) -> Column:
    """0 to 100: each row may hold five points of issues."""
    return F.when(rows > 0, F.greatest(F.lit(0.0), 100 - weighted_issues / (5 * rows) * 100)).otherwise(100.0)


def severity_weight(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(w)) for s, w in SEVERITY_WEIGHTS.items()], F.lit(0.0))


def realtime_score(errors: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - 10 * errors - 2 * warnings)


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("invalid")


def source_score(success_rate: Column, quality: Column, freshness: Column, records: Column, runs: Column) -> Column:
    fresh = F.coalesce(*[F.when(freshness == k, F.lit(v)) for k, v in FRESHNESS_SCORES.items()], F.lit(50.0))
    per_run = F.least(F.lit(100.0), records / F.greatest(runs, F.lit(1)))
    return rounded(0.3 * F.coalesce(success_rate, F.lit(0.0)) + 0.25 * F.coalesce(quality, F.lit(0.0)) + 0.25 * fresh + 0.2 * per_run, 1)


def sla_state(kind: Column, actual: Column, target: Column, warning: Column, critical: Column) -> Column:
    """compliant, at_risk, breached or (where higher is better) critical."""
    low = F.when(actual <= target, "compliant").when(actual <= warning, "at_risk").otherwise("breached")
    high = F.when(actual >= target, "compliant").when(actual >= warning, "at_risk").when(actual >= critical, "breached").otherwise("critical")
    return F.when(kind.isin(*LOWER_IS_BETTER), low).otherwise(high)


def freshness_state(age_hours: Column, warning: Column, critical: Column, enabled: Column | None = None) -> Column:
    state = F.when(age_hours.isNull() | (age_hours >= critical), "critical").when(age_hours >= warning, "stale").otherwise("fresh")
    return state if enabled is None else F.when(~enabled, "disabled").otherwise(state)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in percent; null if there is no whole."""
    return rounded(F.try_divide(part * 100.0, whole.cast("double")), digits)
