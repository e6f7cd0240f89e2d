"""Visitor ratios of the new-versus-returning report (half-up, 0 without visits)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _ratio(n: Column, d: Column, scale: int) -> Column:
    n, d = n.cast("decimal(20,0)"), d.cast("decimal(20,0)")
    return F.when(d != 0, F.round(n / d, scale)).otherwise(F.lit(0)).cast(f"decimal(20,{scale})")


def bounce_rate(uj: Column, sv: Column) -> Column:
    """Bounces per visit, in per cent, two places."""
    return _ratio(uj * 100, sv, 2)


def seconds_per_visit(dur_ms: Column, sv: Column) -> Column:
    """Whole milliseconds per visit first, then seconds to one place."""
    millis = _ratio(dur_ms, sv, 0)
    return F.round(millis / F.lit(1000).cast("decimal(4,0)"), 1).cast("decimal(20,1)")


def pages_per_visit(pv: Column, sv: Column) -> Column:
    return _ratio(pv, sv, 2)
