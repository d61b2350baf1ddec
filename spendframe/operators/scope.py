"""The filter row as a value: date range plus four IN-lists."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: names a caller may group by ------------------------------------------
DIMENSIONS = {
    "cloud": "ProviderName",
    "service_category": "ServiceCategory",
    "service": "ServiceName",
    "region": "RegionId",
    "sub_account": "SubAccountId",
    "application": "tag_application",
    "business_unit": "tag_business_unit",
    "environment": "tag_environment",
    "cost_center": "tag_cost_center",
    "charge_category": "ChargeCategory",
}
FILTER_COLUMNS = {
    "clouds": "ProviderName",
    "applications": "tag_application",
    "business_units": "tag_business_unit",
    "environments": "tag_environment",
}
#: Months read when a scope has no start.
DEFAULT_WINDOW_MONTHS = 25


def dimension(name: str) -> str:
    """Column behind a dimension name; physical names pass; anything else is refused."""
    column = DIMENSIONS.get((name or "").strip().lower())
    if column is None and name in DIMENSIONS.values():
        column = name
    if column is None:
        raise ValueError(f"Unknown dimension {name!r}; use one of {', '.join(sorted(DIMENSIONS))}")
    return column


def months_back(day: dt.date, months: int) -> dt.date:
    """The same day `months` earlier, clamped to the month's end."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    next_month = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (next_month - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


@dataclass(frozen=True)
class Scope:
    """`end` is inclusive at midnight, as reports use it; sources filter half-open ranges."""

    start: dt.date | None = None
    end: dt.date | None = None
    clouds: tuple[str, ...] = ()
    applications: tuple[str, ...] = ()
    business_units: tuple[str, ...] = ()
    environments: tuple[str, ...] = ()

    def conditions(self) -> list[Column]:
        out = []
        if self.start:
            out.append(F.col("ChargePeriodStart") >= F.lit(self.start))
        if self.end:
            out.append(F.col("ChargePeriodStart") <= F.lit(self.end))
        for field, column in FILTER_COLUMNS.items():
            if getattr(self, field):
                out.append(F.col(column).isin(list(getattr(self, field))))
        return out

    def bounded(self, today: dt.date) -> "Scope":
        """The same scope with a start, so a partitioned read is always pruned."""
        if self.start:
            return self
        return Scope(months_back(today, DEFAULT_WINDOW_MONTHS), self.end, self.clouds,
                     self.applications, self.business_units, self.environments)

    def apply(self, charges: DataFrame) -> DataFrame:
        for condition in self.conditions():
            charges = charges.filter(condition)
        return charges

    def apply_budgets(self, budgets: DataFrame) -> DataFrame:
        """Budgets only know cloud and application."""
        if self.clouds:
            budgets = budgets.filter(F.col("cloud").isin(list(self.clouds)))
        if self.applications:
            budgets = budgets.filter(F.col("application").isin(list(self.applications)))
        return budgets
