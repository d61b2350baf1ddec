"""Budget variance, bridge, year-end projection, burn-down and run rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendframe.functions.columns import COST, month, usage
from spendframe.functions.totals import beside_totals
from spendframe.operators.kpi import with_projection, with_variance

# --- fixed values: dimension -> (charge column, budget column) ---------------------------
DIMENSIONS = {
    "cloud": ("ProviderName", "cloud"),
    "application": ("tag_application", "application"),
    "business_unit": ("tag_business_unit", None),
    "period": ("period", "period"),
}


def actuals(charges: DataFrame) -> DataFrame:
    """Usage rows with a month key: purchases, tax and credits are not budgeted."""
    return charges.filter(usage()).withColumn("period", month())


def _months(budgets: DataFrame) -> DataFrame:
    return budgets.withColumn("period", F.trunc(F.col("period").cast("date"), "month"))


def monthly_actuals(charges: DataFrame) -> DataFrame:
    return actuals(charges).groupBy("period").agg(F.sum(COST).cast("double").alias("actual"))


def _planned(budgets: DataFrame) -> DataFrame:
    """Budget rows in the shape of the monthly report."""
    return _months(budgets).select("period", "cloud", "application", F.lit(False).alias("observed"), F.lit(0).alias("actual"),
                                   F.col("budget").cast("double").alias("budget"))


def side_by_side(charges: DataFrame, budgets: DataFrame) -> DataFrame:
    """Facts summed per month, cloud and application, and budget rows below them, for the questions that end in `_of`.

    `observed` tells the two apart. Both meet in the one aggregate of the question, so neither side is joined or read twice.
    """
    report = monthly_report(charges).withColumn("observed", F.lit(True)).withColumn("budget", F.lit(None).cast("double"))
    return report.unionByName(_planned(budgets).withColumn("actual", F.col("actual").cast(report.schema["actual"].dataType)))


def variance_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Actual against budget per group, whichever side knows it; rows without one of the keys are left out."""
    sums = rows.dropna(subset=by).groupBy(*by).agg(
        F.coalesce(F.sum("actual").cast("double"), F.lit(0.0)).alias("actual"), F.coalesce(F.sum("budget"), F.lit(0.0)).alias("budget"))
    return with_variance(sums)


def variance_table(charges: DataFrame, budgets: DataFrame, by: list[str]) -> DataFrame:
    """As `variance_of`, from charges and a budget table.

    A grain budgets are not struck at gets budget 0 and status `unknown`.
    """
    if None not in [DIMENSIONS[b][1] for b in by]:
        return variance_of(side_by_side(charges, budgets), by)
    facts = actuals(charges).select(*[F.col(DIMENSIONS[b][0]).alias(b) for b in by], F.col(COST).alias("actual"))
    return variance_of(facts.withColumn("budget", F.lit(None).cast("double")), by)


def _waterfall(start: Column, steps: Column) -> Column:
    """The array (position, label, delta, level) of a waterfall: `start`, the `steps` (label, delta) in order, what they lead to."""
    def entry(position: Column, label: Column, delta: Column, level: Column) -> Column:
        return F.struct(position.cast("int").alias("position"), label.alias("label"), delta.alias("delta"), level.alias("level"))

    def added(n: Column) -> Column:
        return start + F.aggregate(F.slice(steps, 1, n), F.lit(0.0), lambda sum_, s: sum_ + F.coalesce(s["delta"], F.lit(0.0)))

    inner = F.transform(steps, lambda s, i: entry(i + 1, s["label"], s["delta"], added(i + 1)))
    end = added(F.size(steps))
    return F.concat(F.array(entry(F.lit(0), F.lit("Budget"), start, start)), inner,
                    F.array(entry(F.size(steps) + 1, F.lit("Forecast"), end, end)))


def bridge(budget_total: DataFrame, drivers: DataFrame) -> DataFrame:
    """Waterfall: the budget, each signed driver, the forecast they lead to.

    `budget_total` is one row (budget), `drivers` has (position, label, delta) with positions from 1. The drivers of
    a chart are few; they become one array, and each input is read once.
    """
    start = budget_total.select(F.lit(0).alias("position"), F.lit("Budget").alias("label"), F.col("budget").cast("double").alias("delta"))
    rows = start.unionByName(drivers.select(F.col("position").cast("int").alias("position"), "label", F.col("delta").cast("double").alias("delta")))
    row = rows.agg(F.array_sort(F.collect_list(F.struct("position", "label", "delta"))).alias("s"))
    drawn = _waterfall(F.col("s")[0]["delta"], F.slice("s", 2, F.size("s")))
    return row.select(F.explode(drawn).alias("r")).select("r.*")


def variance_bridge(variances: DataFrame, label: str) -> DataFrame:
    """The waterfall from the whole budget over each group's variance, groups by name; the variance table is made once."""
    row = variances.agg(F.sum("budget").alias("budget"), F.array_sort(F.collect_list(
        F.struct(F.col(label).alias("label"), F.col("variance_abs").alias("delta")))).alias("s"))
    return row.select(F.explode(_waterfall(F.col("budget"), F.col("s"))).alias("r")).select("r.*")


def year_end_projection(charges: DataFrame, budgets: DataFrame, forecast: DataFrame,
                        fiscal_year_start_month: int = 1) -> DataFrame:
    """Actuals of the fiscal year so far plus the forecast for its remaining months."""
    return year_end_of(side_by_side(charges, budgets), forecast, fiscal_year_start_month)


def year_end_of(rows: DataFrame, forecast: DataFrame, fiscal_year_start_month: int = 1) -> DataFrame:
    """As `year_end_projection`, from facts and budgets side by side.

    All inputs become one month-level frame, so the fiscal window around the last actual month is found and applied
    without joining them.
    """
    kinds = F.array(F.struct(F.lit("actual").alias("kind"), F.when(F.col("seen"), F.col("actual")).alias("amount")),
                    F.struct(F.lit("budget").alias("kind"), F.col("budget").alias("amount")))
    known = _by_month(rows).select("period", "seen", F.explode(kinds).alias("k")).filter("seen or k.kind = 'budget'")
    rows = known.select("k.kind", "period", "k.amount").union(
        _months(forecast).select(F.lit("forecast"), "period", F.col("cost").cast("double")))
    last = F.max(F.when(F.col("kind") == "actual", F.col("period"))).over(Window.partitionBy())
    rows = rows.withColumn("last", last)
    this_year = F.make_date(F.year("last"), F.lit(fiscal_year_start_month), F.lit(1))
    rows = rows.withColumn("fy_start", F.when(F.col("last") < this_year, F.add_months(this_year, -12)).otherwise(this_year))
    rows = rows.withColumn("fy_end", F.add_months("fy_start", 12))
    kind, p = F.col("kind"), F.col("period")
    in_year = (p >= F.col("fy_start")) & (p < F.col("fy_end"))
    ahead = (kind == "forecast") & (p > F.col("last")) & (p < F.col("fy_end"))

    def amount(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0.0))

    row = rows.agg(amount((kind == "actual") & in_year).alias("ytd"), amount(ahead).alias("remaining"),
                   amount((kind == "budget") & in_year).alias("annual_budget"),
                   F.count_if(ahead).alias("months_remaining"))
    return with_projection(row).select("projected_spend", "annual_budget", "variance_abs", "variance_pct",
                                       "direction", "months_remaining")


def _by_month(rows: DataFrame) -> DataFrame:
    return rows.groupBy("period").agg(F.sum("actual").cast("double").alias("actual"), F.sum("budget").alias("budget"),
                                      F.bool_or("observed").alias("seen"))


def burn_down(charges: DataFrame, budgets: DataFrame) -> DataFrame:
    """Running actual against running budget over the observed months."""
    return burn_down_of(side_by_side(charges, budgets))


def burn_down_of(rows: DataFrame) -> DataFrame:
    """As `burn_down`, from facts and budgets side by side."""
    run = Window.partitionBy().orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    rows = _by_month(rows).filter("seen")
    rows = rows.select("period", F.sum("actual").over(run).alias("cumulative_actual"),
                       F.sum(F.coalesce("budget", F.lit(0.0))).over(run).alias("cumulative_budget"))
    pace = F.when(F.col("cumulative_budget") > 0, F.col("cumulative_actual") / F.col("cumulative_budget"))
    return rows.withColumn("pace", pace)


def run_rate_table(charges: DataFrame) -> DataFrame:
    """Per cloud in the last month: spend, per elapsed day, per year.

    Elapsed days are the latest charge day of the month over all clouds.
    """
    report = (actuals(charges).groupBy("period", "ProviderName")
              .agg(F.sum(COST).cast("double").alias("mtd"), F.max(F.dayofmonth("ChargePeriodStart")).alias("dom")))
    estate = Window.partitionBy()
    last = report.withColumn("last", F.max("period").over(estate)).filter("period = last")
    daily = F.col("mtd") / F.greatest(F.col("elapsed"), F.lit(1))
    return (last.withColumn("elapsed", F.max("dom").over(estate)).filter("ProviderName is not null")
            .select(F.col("ProviderName").alias("cloud"), "mtd", daily.alias("burn_rate_daily"),
                    (daily * 365.0).alias("run_rate_annual")))


def monthly_report(charges: DataFrame) -> DataFrame:
    """(period, cloud, application, actual): what every budget question is asked of, one pass over the charges.

    Decimal costs stay exact here.
    """
    return (actuals(charges).groupBy("period", F.col("ProviderName").alias("cloud"), F.col("tag_application").alias("application"))
            .agg(F.sum(COST).alias("actual")))


def budget_from_history(charges: DataFrame, uplift: float = 0.06) -> DataFrame:
    """First-year monthly mean per cloud and application, grown by `uplift` a year."""
    return budget_from_report(monthly_report(charges), uplift)


def budget_from_report(report: DataFrame, uplift: float = 0.06) -> DataFrame:
    """As `budget_from_history`, from the monthly report."""
    return with_history_budget(report, uplift).filter("budgeted").select("period", "cloud", "application", "budget")


def with_history_budget(report: DataFrame, uplift: float = 0.06) -> DataFrame:
    """The monthly report with the budget its own history suggests, facts and budgets side by side in one plan.

    Groups without a first year take their own actual as base; rows without a cloud or an application are not `budgeted`.
    The first month of the estate stands beside the rows; the means are windows inside each group.
    """
    budgeted = F.col("cloud").isNotNull() & F.col("application").isNotNull()
    rows = beside_totals(report, ["period", "cloud", "application"], {"first": F.min(F.when(budgeted, F.col("period")))})
    group, cost = Window.partitionBy("cloud", "application"), F.col("actual").cast("double")
    base = F.avg(F.when(F.col("period") <= F.add_months("first", 11), cost)).over(group)
    years = F.datediff("period", "first") / 30.44 / 12.0
    return rows.withColumn("base", F.coalesce(base, cost)).select(
        "period", "cloud", "application", "actual", F.lit(True).alias("observed"), budgeted.alias("budgeted"),
        F.when(budgeted, F.col("base") * F.pow(F.lit(1.0 + uplift), years)).alias("budget"))
