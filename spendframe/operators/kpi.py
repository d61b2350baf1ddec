"""Executive KPIs.

Every figure comes from one aggregate over the charges, keyed by charge-period start: all the
sums are additive, so months, trailing windows and totals are folded from that small frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendframe.functions.columns import (
    COST, LIST, has_commitment, maturity, month, pct, ratio, readiness, total, usage, variance_status,
)
from spendframe.functions.focus import COMMITMENT_ELIGIBLE, UNALLOCATED
from spendframe.functions.totals import beside_totals
from spendframe.operators.rollups import monthly


def eligible() -> Column:
    """Usage a commitment could cover. Unpriced rows count; only `Dynamic` is out."""
    return (usage() & F.col("ServiceCategory").isin(COMMITMENT_ELIGIBLE)
            & ~F.col("PricingCategory").eqNullSafe("Dynamic"))


def _status(value: str) -> Column:
    return has_commitment() & (F.col("CommitmentDiscountStatus") == value)


def _parts() -> dict[str, tuple[str, Column | None]]:
    """Additive components: name -> (column, condition)."""
    return {
        "spend": (COST, None),
        "usage_list": (LIST, usage()),
        "usage_cost": (COST, usage()),
        "eligible_list": (LIST, eligible()),
        "covered_list": (LIST, eligible() & has_commitment()),
        "used": (COST, _status("Used")),
        "unused": (COST, _status("Unused")),
        "commitment_cost": (COST, has_commitment()),
        "committed_list": (LIST, usage() & has_commitment()),
        "committed_cost": (COST, usage() & has_commitment()),
        "allocated": (COST, F.col("tag_application") != UNALLOCATED),
    }


def _sums(only: list[str] | None = None) -> list[Column]:
    return [F.sum(F.col(c) if cond is None else F.when(cond, F.col(c))).alias(name)
            for name, (c, cond) in _parts().items() if only is None or name in only]


def components(charges: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The conditional sums of the estate, still exact."""
    return charges.agg(*_sums(only))


def _d(name: str) -> Column:
    """A component as double, 0 when no row qualified."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


# --- formulas over the components -------------------------------------------------------
def coverage_pct() -> Column:
    return pct(F.coalesce("covered_list", F.lit(0)), F.col("eligible_list"))


def utilization_pct() -> Column:
    return pct(_d("used"), _d("used") + _d("unused"))


def waste_share_pct() -> Column:
    return pct(_d("unused"), F.col("commitment_cost"))


def esr_pct(cost_to_achieve: float = 0.0) -> Column:
    return pct(_d("usage_list") - _d("usage_cost") - F.lit(cost_to_achieve), _d("usage_list"))


def discount_pct() -> Column:
    return pct(_d("committed_list") - _d("committed_cost"), _d("committed_list"))


def implied_esr_pct() -> Column:
    return (utilization_pct() / 100.0) * (coverage_pct() / 100.0) * (discount_pct() / 100.0) * 100.0


def allocation_pct() -> Column:
    return pct(_d("allocated"), _d("spend"))


# --- single KPIs -------------------------------------------------------------------------
def total_spend(charges: DataFrame) -> DataFrame:
    return charges.agg(total(COST).alias("total_spend"))


def month_deltas(charges: DataFrame) -> DataFrame:
    """Per month: change against the previous and the twelfth previous *present* month."""
    order = Window.partitionBy().orderBy("period")
    rows = monthly(charges)
    for name, back in (("mom_pct", 1), ("yoy_pct", 12)):
        prior = F.lag("cost", back).over(order)
        rows = rows.withColumn(name, pct(F.col("cost") - prior, prior))
    return rows


def _last_delta(series: Column, back: int) -> Column:
    """Change of the last entry of a sorted (month, cost) array against the one `back` earlier."""
    last = F.try_element_at(series, F.lit(-1))["cost"]
    prior = F.try_element_at(series, F.lit(-1 - back))["cost"]
    return pct(last - prior, prior)


def latest_deltas(charges: DataFrame) -> DataFrame:
    """One row: last month against the previous and the thirteenth-last present month."""
    series = F.array_sort(F.collect_list(F.struct("period", "cost")))
    return (monthly(charges).agg(series.alias("s"))
            .select(_last_delta(F.col("s"), 1).alias("mom_pct"), _last_delta(F.col("s"), 12).alias("yoy_pct")))


def _span(start: Column, end: Column) -> Column:
    return F.timestamp_diff("DAY", start, end)


def burn_rate(charges: DataFrame) -> DataFrame:
    """Spend per day of the observed window, and the same times 365. No rows: null."""
    row = charges.agg(F.sum(COST).cast("double").alias("spend"),
                      F.min("ChargePeriodStart").alias("lo"), F.max("ChargePeriodEnd").alias("hi"))
    burn = F.col("spend") / F.greatest(_span(F.col("lo"), F.col("hi")), F.lit(1))
    return row.select(burn.alias("burn_rate"), (burn * 365.0).alias("run_rate"))


def commitment_coverage(charges: DataFrame) -> DataFrame:
    return components(charges, ["eligible_list", "covered_list"]).select(coverage_pct().alias("coverage_pct"))


def commitment_utilization(charges: DataFrame) -> DataFrame:
    return components(charges, ["used", "unused"]).select(utilization_pct().alias("utilization_pct"))


def commitment_waste(charges: DataFrame) -> DataFrame:
    return components(charges, ["unused", "commitment_cost"]).select(
        _d("unused").alias("commitment_waste"), waste_share_pct().alias("commitment_waste_pct"))


def on_demand_equivalent(charges: DataFrame) -> DataFrame:
    return components(charges, ["usage_list"]).select(_d("usage_list").alias("on_demand_equivalent"))


def effective_savings_rate(charges: DataFrame, cost_to_achieve: float = 0.0) -> DataFrame:
    return components(charges, ["usage_list", "usage_cost"]).select(esr_pct(cost_to_achieve).alias("esr_pct"))


def esr_components(charges: DataFrame) -> DataFrame:
    return components(charges).select(
        utilization_pct().alias("utilization_pct"), coverage_pct().alias("coverage_pct"),
        discount_pct().alias("discount_pct"), implied_esr_pct().alias("implied_esr_pct"))


def _months_observed(lo: Column, hi: Column) -> Column:
    return F.coalesce(F.greatest(_span(lo, hi) / 30.44, F.lit(1.0)), F.lit(1.0))


def months_observed(charges: DataFrame) -> DataFrame:
    return (charges.agg(F.min("ChargePeriodStart").alias("lo"), F.max("ChargePeriodStart").alias("hi"))
            .select(_months_observed(F.col("lo"), F.col("hi")).alias("months_observed")))


def allocation_coverage(charges: DataFrame, tags: list[str] = ["application"]) -> DataFrame:
    """One row per tag key: coverage %, unallocated %, readiness."""
    sums = charges.agg(F.sum(COST).alias("spend"), *[
        F.sum(F.when(F.col(f"tag_{t}") != UNALLOCATED, F.col(COST))).alias(t) for t in tags])
    long = F.explode(F.array(*[F.struct(F.lit(t).alias("tag_key"), _d(t).alias("allocated")) for t in tags]))
    covered = pct(F.col("allocated"), _d("spend"))
    return (sums.select("spend", long.alias("r")).select("spend", "r.*")
            .select("tag_key", covered.alias("coverage_pct"), (100.0 - covered).alias("unallocated_pct"),
                    readiness(covered).alias("readiness")))


def unit_cost(charges: DataFrame, driver_value: float) -> DataFrame:
    return charges.agg(ratio(total(COST), F.lit(driver_value)).alias("unit_cost"))


def unit_cost_series(charges: DataFrame, drivers: DataFrame, metric: str) -> DataFrame:
    """Month spend over one driver metric; months without the driver are left out."""
    chosen = drivers.filter(F.col("metric") == metric).select(F.trunc("period", "month").alias("period"), "value")
    return (monthly(charges).join(chosen, "period")
            .withColumn("unit_cost", ratio(F.col("cost"), F.col("value"))))


def with_variance(df: DataFrame, actual: str = "actual", budget: str = "budget") -> DataFrame:
    """Absolute and relative variance, direction and status per row."""
    gap = F.col(actual) - F.col(budget)
    share = pct(gap, F.col(budget))
    return df.withColumns({
        "variance_abs": gap, "variance_pct": share,
        "direction": F.when(gap > 0, "Overrun").otherwise("Underrun"),
        "status": variance_status(share),
    })


def with_projection(df: DataFrame) -> DataFrame:
    """Year-end figures from `ytd`, `remaining` and `annual_budget`."""
    projected = F.col("ytd") + F.col("remaining")
    gap = projected - F.col("annual_budget")
    return df.withColumns({
        "projected_spend": projected, "variance_abs": gap,
        "variance_pct": pct(gap, F.col("annual_budget")),
        "direction": F.when(gap > 0, "Overrun").otherwise("Underrun"),
    })


def accuracy(pairs: DataFrame, by: list[str] = [], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """MAPE (skips actual 0), WAPE (null without any actual), sMAPE (skips empty pairs)."""
    a, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    err, mid = F.abs(a - f), (F.abs(a) + F.abs(f)) / 2.0
    return pairs.groupBy(*by).agg(
        (F.avg(F.when(a != 0, err / F.abs(a))) * 100.0).alias("mape"),
        pct(F.sum(err), F.sum(F.abs(a))).alias("wape"),
        (F.avg(F.when(mid != 0, err / mid)) * 100.0).alias("smape"))


def _by_start(charges: DataFrame) -> DataFrame:
    """Spend per charge-period start with the estate's last start next to it.

    One row per distinct start (the hours or days of the window), whatever the row count.
    """
    starts = charges.groupBy(F.col("ChargePeriodStart").alias("start")).agg(F.sum(COST).alias("cost"))
    return beside_totals(starts, ["start"], {"last": F.max("start")})


def _after(days: int) -> Column:
    return F.col("start") > F.col("last") - F.expr(f"INTERVAL '{days}' DAY")


def trailing_baseline(charges: DataFrame, days: int = 90) -> DataFrame:
    """Spend of the last `days` days over `days`, also when fewer were observed."""
    return _by_start(charges).agg(
        (F.sum(F.when(_after(days), F.col("cost"))).cast("double") / days).alias("baseline"))


def baseline_drift(charges: DataFrame, days: int = 90, recent_days: int = 30) -> DataFrame:
    sums = _by_start(charges).agg(*[
        (F.sum(F.when(_after(n), F.col("cost"))).cast("double") / n).alias(name)
        for n, name in ((days, "base"), (recent_days, "recent"))])
    return sums.select(pct(F.col("recent") - F.col("base"), F.col("base")).alias("baseline_drift_pct"))


def cost_of_waste(charges: DataFrame, usage_waste_monthly: Column | float) -> DataFrame:
    """Commitment waste of the window plus the monthly usage waste over its months."""
    return executive_summary(charges, usage_waste_monthly).select("cost_of_waste", "waste_pct")


def executive_summary(charges: DataFrame, usage_waste_monthly: Column | float = 0.0) -> DataFrame:
    """One row, 13 figures, one pass over the charges.

    `usage_waste_monthly` is a number or a scalar subquery over the opportunities.
    """
    waste = usage_waste_monthly if isinstance(usage_waste_monthly, Column) else F.lit(usage_waste_monthly)
    names = list(_parts())
    starts = charges.groupBy(F.col("ChargePeriodStart").alias("start")).agg(
        F.max("ChargePeriodEnd").alias("hi"), *_sums())
    starts = beside_totals(starts, ["start"], {"last": F.max("start")})
    months = starts.groupBy(F.trunc(F.col("start").cast("date"), "month").alias("period")).agg(
        *[F.sum(n).alias(n) for n in names], F.min("start").alias("lo"), F.max("start").alias("last"),
        F.max("hi").alias("hi"),
        F.sum(F.when(_after(90), F.col("spend"))).alias("d90"),
        F.sum(F.when(_after(30), F.col("spend"))).alias("d30"))
    row = months.agg(
        *[F.sum(n).alias(n) for n in names], F.min("lo").alias("lo"), F.max("last").alias("last"),
        F.max("hi").alias("hi"), F.sum("d90").alias("d90"), F.sum("d30").alias("d30"),
        F.array_sort(F.collect_list(F.struct("period", F.col("spend").cast("double").alias("cost")))).alias("s"))
    row = row.withColumn("usage_waste", F.coalesce(waste, F.lit(0.0)))
    of_waste = _d("unused") + F.col("usage_waste") * _months_observed(F.col("lo"), F.col("last"))
    base, recent = F.col("d90").cast("double") / 90, F.col("d30").cast("double") / 30
    return row.select(
        _d("spend").alias("total_spend"),
        _last_delta(F.col("s"), 1).alias("mom_pct"),
        _last_delta(F.col("s"), 12).alias("yoy_pct"),
        (F.col("spend").cast("double") / F.greatest(_span(F.col("lo"), F.col("hi")), F.lit(1)) * 365.0).alias("run_rate"),
        esr_pct().alias("esr_pct"),
        coverage_pct().alias("coverage_pct"),
        utilization_pct().alias("utilization_pct"),
        _d("unused").alias("commitment_waste"),
        of_waste.alias("cost_of_waste"),
        pct(of_waste, _d("spend")).alias("waste_pct"),
        allocation_pct().alias("allocation_coverage_pct"),
        readiness(allocation_pct()).alias("chargeback_readiness"),
        pct(recent - base, base).alias("baseline_drift_pct"))


def commitment_position(charges: DataFrame) -> DataFrame:
    """Coverage, utilisation, savings rate, its factors, waste and on-demand equivalent."""
    return components(charges).select(
        coverage_pct().alias("coverage_pct"), utilization_pct().alias("utilization_pct"),
        esr_pct().alias("esr_pct"), discount_pct().alias("discount_pct"),
        implied_esr_pct().alias("implied_esr_pct"), _d("unused").alias("commitment_waste_usd"),
        _d("usage_list").alias("on_demand_equivalent_usd"))


def with_maturity(df: DataFrame, wape: str = "wape") -> DataFrame:
    return df.withColumn("maturity", maturity(F.col(wape)))
