"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COST, LIST = "EffectiveCost", "ListCost"


def month(column: str = "ChargePeriodStart") -> Column:
    """Month start as a DATE."""
    return F.trunc(F.col(column).cast("date"), "month")


def day(column: str = "ChargePeriodStart") -> Column:
    return F.col(column).cast("date")


def total(value: str | Column, when: Column | None = None) -> Column:
    """Sum as double, 0 when nothing qualifies. Decimals stay exact until the cast."""
    value = F.col(value) if isinstance(value, str) else value
    if when is not None:
        value = F.when(when, value)
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column) -> Column:
    return ratio(num, den) * 100.0


def usage() -> Column:
    return F.col("ChargeCategory") == "Usage"


def has_commitment() -> Column:
    return F.col("CommitmentDiscountId").isNotNull()


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Whole months between two month starts."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier))


def bands(value: Column, edges: list[tuple[float, str]], otherwise: str, op: str) -> Column:
    """First label whose edge the value passes; `op` is one of lt, gt, ge."""
    compare = {"lt": lambda e: value < e, "gt": lambda e: value > e, "ge": lambda e: value >= e}[op]
    out = None
    for edge, label in edges:
        out = F.when(compare(edge), label) if out is None else out.when(compare(edge), label)
    return out.otherwise(otherwise)


# --- fixed values: report thresholds ---------------------------------------------------
def maturity(wape: Column) -> Column:
    label = bands(F.abs(wape), [(5.0, "Best-in-class"), (12.0, "Run"), (15.0, "Walk"), (20.0, "Crawl")],
                  "Below Crawl", "lt")
    return F.when(wape.isNull(), "Unknown").otherwise(label)


def readiness(coverage: Column) -> Column:
    label = bands(coverage, [(95.0, "Chargeback ready"), (90.0, "Chargeback ready (tagged scope)"),
                             (80.0, "Hybrid: chargeback tagged, showback remainder")],
                  "Showback only", "ge")
    return F.when(coverage.isNull(), "Unknown").otherwise(label)


def coverage_status(coverage: Column) -> Column:
    return bands(coverage, [(90.0, "good"), (80.0, "warning")], "critical", "ge")


def variance_status(variance_pct: Column) -> Column:
    return (F.when(variance_pct.isNull(), "unknown").when(variance_pct > 10, "critical")
            .when(variance_pct > 2, "serious").when(variance_pct < -10, "warning").otherwise("good"))


def severity(deviation_pct: Column) -> Column:
    return bands(F.abs(deviation_pct), [(100.0, "critical"), (50.0, "serious"), (25.0, "warning")], "good", "gt")
