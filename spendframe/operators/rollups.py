"""Spend roll-ups. Fact rows are aggregated once; everything after works on the report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from spendframe.functions.columns import COST, day, month
from spendframe.functions.totals import beside_totals, largest
from spendframe.operators.scope import FILTER_COLUMNS, dimension

OTHER = "Other"


def _spend(cost: str) -> Column:
    return F.sum(cost).cast("double").alias("cost")


def monthly(charges: DataFrame, cost: str = COST) -> DataFrame:
    """(period, cost) per month."""
    return charges.groupBy(month().alias("period")).agg(_spend(cost))


def monthly_by(charges: DataFrame, by: str, cost: str = COST) -> DataFrame:
    """(period, dimension, cost); rows without the dimension stay, under null."""
    return charges.groupBy(month().alias("period"), dimension(by)).agg(_spend(cost))


def daily(charges: DataFrame, cost: str = COST) -> DataFrame:
    """(period, cost) per day, all grains: a month row counts on its first day."""
    return charges.groupBy(day().alias("period")).agg(_spend(cost))


def daily_grain(charges: DataFrame, by: str | None = None, cost: str = COST) -> DataFrame:
    """Daily spend of day-grain rows only (charge period of at most two full days).

    Like every series grouping, rows without the dimension are left out.
    """
    rows = charges.filter(F.timestamp_diff("DAY", F.col("ChargePeriodStart"), F.col("ChargePeriodEnd")) <= 2)
    keys = [day().alias("period")]
    if by:
        rows = rows.filter(F.col(by).isNotNull())
        keys.append(F.col(by))
    return rows.groupBy(*keys).agg(_spend(cost))


def filter_values(charges: DataFrame) -> DataFrame:
    """(k, v): distinct values per filter. The four columns are made distinct together first,
    so only their combinations are unpivoted, not the charge rows."""
    combos = charges.select(*FILTER_COLUMNS.values()).distinct()
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in FILTER_COLUMNS.items()])
    return combos.select(F.explode(pairs).alias("p")).select("p.*").filter("v is not null").distinct()


def describe(charges: DataFrame) -> DataFrame:
    """One row: rows and first/last charge day."""
    return charges.agg(F.count(F.lit(1)).alias("rows"),
                       F.min(day()).alias("period_start"), F.max(day()).alias("period_end"))


def trailing_start(as_of: dt.date, months: int) -> dt.date:
    """First of the month reached by going 31 days back per month from this month's first."""
    return (as_of.replace(day=1) - dt.timedelta(days=31 * months)).replace(day=1)


def trailing_breakdown(charges: DataFrame, by: str, months: int, as_of: dt.date, top: int | None = None) -> DataFrame:
    """Values of a dimension over the trailing months (the `top` largest, if given), with the overall total."""
    column = dimension(by)
    rows = charges.filter(F.col("ChargePeriodStart") >= F.lit(trailing_start(as_of, months)))
    totals = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum(COST).alias("c"))
    out = beside_totals(totals, [column], {"total_usd": F.sum("c").cast("double")}).select(
        column, F.col("c").cast("double").alias("cost"), "total_usd")
    return out if top is None else out.orderBy(F.desc("cost"), column).limit(top)


def fold_tail(totals: DataFrame, label: str, limit: int, value: str = "cost") -> DataFrame:
    """Keep the `limit` - 1 largest labels and fold the rest into `Other`; nothing is lost.

    With at most `limit` labels the input comes back unchanged. `totals` has one row per label. Labels are ranked in
    parts, and only the first of each part meet, so they are never ranked in one task and `totals` is computed once.
    """
    marked = largest(totals.filter(F.col(label).isNotNull()), label, value, limit - 1)
    keep = (F.col("labels") <= limit) | F.array_contains("largest", F.col(label))
    return (marked.groupBy(F.when(keep, F.col(label)).otherwise(OTHER).alias(label), (~keep).alias("folded"))
            .agg(F.sum(value).alias(value)))


def totals_by(charges: DataFrame, by: str, cost: str = COST) -> DataFrame:
    """(dimension, cost) with the cost still exact, for folding and ranking."""
    return charges.groupBy(dimension(by)).agg(F.sum(cost).alias("cost"))


def dense_matrix(charges: DataFrame, by: str, top: int | None = None, cost: str = COST) -> DataFrame:
    """Every label (the `top` largest, if given) x every month of the estate, missing cells 0, in long form.

    Each label row expands by the estate's month list, which stands beside every row of the one monthly report,
    so no two tables are crossed.
    """
    column = dimension(by)
    report = charges.groupBy(month().alias("month"), column).agg(F.sum(cost).alias("cost"))
    report = beside_totals(report, ["month", column], {"months": F.array_sort(F.collect_set("month"))})
    cells = report.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.sum("cost").alias("total"), F.first("months").alias("months"),
        F.map_from_entries(F.collect_list(F.struct("month", F.col("cost").cast("double")))).alias("cells"))
    if top is not None:
        cells = cells.orderBy(F.desc("total"), column).limit(top)
    return (cells.select(column, "cells", F.explode("months").alias("month"))
            .select(column, "month", F.coalesce(F.try_element_at("cells", F.col("month")), F.lit(0.0)).alias("cost")))


def hierarchy(charges: DataFrame, level1: str, level2: str, cost: str = COST) -> DataFrame:
    """Root, level 1 and level 2 totals. Rows are summed per leaf before the rollup expands.

    A row without a level has no node there but counts in the ones above it.
    """
    one, two = dimension(level1), dimension(level2)
    leaves = charges.groupBy(one, two).agg(F.sum(cost).alias("c"))
    return (leaves.rollup(one, two).agg(F.sum("c").cast("double").alias("cost"),
                                        F.grouping_id().alias("g"))
            .filter((F.col("g") > 1) | (F.col(one).isNotNull() & ((F.col("g") == 1) | F.col(two).isNotNull())))
            .select(F.when(F.col("g") == 0, 2).when(F.col("g") == 1, 1).otherwise(0).alias("level"),
                    F.col(one).alias("level1"), F.col(two).alias("level2"), "cost"))


def drill_down(charges: DataFrame, by: str, value: str, cost: str = COST) -> DataFrame:
    """Monthly series of one value of a dimension."""
    return monthly(charges.filter(F.col(dimension(by)) == value), cost)


def label_parts(df: DataFrame, label: str = "cloud") -> DataFrame:
    """Distinct providers named in composite labels such as `AWS, Azure`."""
    return (df.select(F.explode(F.split(label, ",")).alias("p"))
            .select(F.trim("p").alias(label)).filter(F.col(label) != "").distinct())


def label_contains(df: DataFrame, text: str, label: str = "cloud") -> DataFrame:
    return df.filter(F.col(label).contains(text))


def dimension_totals(charges: DataFrame, names: list[str], cost: str = COST) -> DataFrame:
    """(dimension, value, cost) for several dimensions in one pass.

    Rows are summed per combination first, so only combinations are unpivoted.
    """
    columns = {name: dimension(name) for name in names}
    combos = charges.groupBy(*columns.values()).agg(F.sum(cost).alias("c"))
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in columns.items()])
    return (combos.select(F.explode(pairs).alias("p"), "c").groupBy("p.dimension", "p.value")
            .agg(F.sum("c").cast("double").alias("cost")))
