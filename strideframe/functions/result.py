"""Typed absence: a metric is a value, or the reason why there is none. Never a stand-in number.

The reason set is closed. A ladder lists (condition, reason) in the order of precedence; a condition that is null does
not hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REASONS = ("insufficient_data", "missing_required_input", "missing_dependency", "poor_fit", "out_of_domain", "not_seeded", "not_applicable_for_sport")


def ladder(steps: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first condition that holds, null if none does."""
    unknown = [reason for _, reason in steps if reason not in REASONS]
    if unknown:
        raise ValueError(f"not a reason: {unknown}")
    out = F.lit(None).cast("string")
    for condition, reason in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(a: Column, b: Column | float) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double") if isinstance(b, Column) else F.lit(float(b)))


def computed(value: Column, reason: Column) -> Column:
    """The value where there is no reason against it; NaN and infinities never pass."""
    return F.when(reason.isNull() & finite(value), value)


def result(value: Column, reason: Column, confidence: Column | float = 1.0, coverage: Column | float = 1.0, gaps: Column | int = 0) -> Column:
    """The struct of a metric: available, value, reason, confidence, coverage_fraction, gap_count."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    why = F.when(reason.isNotNull(), reason).when(~F.coalesce(finite(value), F.lit(False)), F.lit("out_of_domain"))
    live = why.isNull()
    return F.struct(
        live.alias("available"), F.when(live, value).alias("value"), why.alias("reason"),
        F.when(live, as_column(confidence).cast("double")).alias("confidence"),
        F.when(live, as_column(coverage).cast("double")).alias("coverage_fraction"),
        F.when(live, as_column(gaps).cast("long")).alias("gap_count"),
    )
