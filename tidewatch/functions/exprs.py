"""Scalar building blocks: as SQL text for plans, and as Columns for DataFrame code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Confidence bounds of the severities, their last one open.
BOUNDS = (0.20, 0.40, 0.60, 0.80)


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def severity(x: str) -> str:
    cases = " ".join(f"WHEN {x} < {b} THEN '{s}'" for b, s in zip(BOUNDS, SEVERITIES, strict=False))
    return f"CASE {cases} ELSE 'critical' END"


def severity_rank(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEVERITIES)) + " END"


def severity_name(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SEVERITIES)) + " END"


def decay(age_hours: str, half_life: float) -> str:
    return f"(CASE WHEN {age_hours} < 0 THEN 0 ELSE exp(-({age_hours}) * ln(2) / {half_life}) END)"


def established() -> str:
    """A token that is listed, verified with a good score, or has a very good score; no score counts as 100."""
    return "(jup_strict OR (jup_verified AND coalesce(rugcheck, 100) < 40) OR coalesce(rugcheck, 100) < 30)"


def flag(x: str) -> str:
    return f"(CASE WHEN {x} THEN 1 ELSE 0 END)"


def graduation(age_hours: str) -> str:
    """Multiplier of a recent launchpad graduation."""
    return f"(CASE WHEN {age_hours} < 1 THEN 1.50 WHEN {age_hours} < 24 THEN 1.30 WHEN {age_hours} < 72 THEN 1.15 WHEN {age_hours} < 168 THEN 1.05 ELSE 1.0 END)"


def sigmoid_col(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp_col(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def severity_col(x: Column) -> Column:
    out = F.when(x < BOUNDS[0], SEVERITIES[0])
    for b, s in zip(BOUNDS[1:], SEVERITIES[1:], strict=False):
        out = out.when(x < b, s)
    return out.otherwise(SEVERITIES[-1])


def decay_col(age_hours: Column, half_life: float) -> Column:
    return F.when(age_hours < 0, F.lit(0.0)).otherwise(F.exp(-age_hours * F.log(F.lit(2.0)) / half_life))
