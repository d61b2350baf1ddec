"""Every operator as a query over the test tables, by inventory id."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spendframe.functions import columns as cols, focus
from spendframe.operators import (
    allocation as al, anomaly as an, budget as bu, forecast as fc, kpi, levers, normalize as nz, optimize as op,
    rollups as ru, seasonal as sn, validate as va,
)
from spendframe.operators.scope import DIMENSIONS, Scope, months_back
from spendframe.plans import nightly, sinks
from spendframe.sources import files, testcharges as tc, warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES = ["ProviderName", "ServiceCategory"]
AS_OF = dt.date(2001, 9, 30)
HORIZON = 14


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return add


def on_charges(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: fn(tc.charges(spark, sf))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round the named (default: all) double columns; -0.0 becomes 0.0."""
    names = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def r6(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df, 6, *names)


def r2(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df, 2, *names)


# --- sources ---------------------------------------------------------------------------
@query("S02_date_guard")
def _(spark, sf):
    c = tc.charges(spark, sf).withColumn(
        "ChargePeriodStart", F.when(F.col("charge_key") % 5 == 0, "no date")
        .otherwise(F.col("ChargePeriodStart").cast("string")))
    feed = nz.tolerant_cast(c)
    kept = files.date_range(feed, dt.date(2000, 1, 1), dt.date(2001, 1, 1))
    return kept.groupBy("ProviderName").agg(F.count(F.lit(1)).alias("rows"))


@query("S07_bounded_scan")
def _(spark, sf):
    scope = Scope(clouds=("AWS", "GCP")).bounded(dt.date(2002, 6, 15))
    return scope.apply(tc.charges(spark, sf)).groupBy("ProviderName").agg(
        F.count(F.lit(1)).alias("rows"), F.min(cols.day()).alias("first_day"), cols.total(cols.COST).alias("cost"))


@query("S08_opportunity_window")
def _(spark, sf):
    scope = Scope(start=months_back(AS_OF, warehouse.SNAPSHOT_WINDOW_MONTHS))
    return scope.apply(tc.charges(spark, sf)).groupBy("ProviderName").agg(
        F.count(F.lit(1)).alias("rows"), F.min(cols.day()).alias("first_day"), cols.total(cols.COST).alias("cost"))


def _snapshot(rows: DataFrame, as_of: dt.date) -> DataFrame:
    return op.snapshot(rows, as_of, dt.datetime(2001, 9, 30, 3, 45)).select(
        "as_of", "lever_id", "cloud", "scope", F.col("monthly_savings").cast("double"), F.col("annual_savings").cast("double"))


@query("S09_latest_snapshot")
def _(spark, sf):
    found = op.detect(tc.charges(spark, sf))
    older = found.withColumn("annual_savings", F.lit(1.0))
    rows = _snapshot(older, AS_OF - dt.timedelta(days=1)).union(_snapshot(found, AS_OF))
    return warehouse.latest(rows, ("AWS", "OCI"))


def _stored(c: DataFrame) -> DataFrame:
    """Charges with the partition columns of the table at rest."""
    return c.select(F.col("ProviderName").alias("_binding"), F.col("ChargePeriodStart").alias("charge_date"), "charge_key", cols.COST)


def _per_binding(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_binding").agg(F.count(F.lit(1)).alias("rows"), F.min("charge_date").alias("first_day"), cols.total(cols.COST).alias("cost"))


@query("S11_replaced_windows")
def _(spark, sf):
    """Two bindings' windows replaced by a third of their rows at double cost; everything else stays."""
    stored = _stored(tc.charges(spark, sf))
    windows = [{"key": "AWS", "lo": "2001-01-01", "hi": "2001-06-30"}, {"key": "GCP", "lo": "1998-01-01", "hi": "1999-12-31"}]
    new = sinks.within(stored, windows, "charge_date", "_binding").filter(F.col("charge_key") % 3 == 0).withColumn(
        cols.COST, (F.col(cols.COST) * 2).cast("decimal(28,6)"))
    current = stored.withColumn(cols.COST, F.col(cols.COST).cast("decimal(28,6)"))
    return _per_binding(sinks.replaced(current, new.select(current.columns), windows, "charge_date", "_binding"))


@query("S12_replaced_snapshot")
def _(spark, sf):
    """Two days of snapshots of which the newer one is replaced by fewer rows."""
    found = op.detect(tc.charges(spark, sf))
    day = {"key": None, "lo": AS_OF.isoformat(), "hi": AS_OF.isoformat()}
    current = _snapshot(found, AS_OF - dt.timedelta(days=1)).union(_snapshot(found, AS_OF))
    out = sinks.replaced(current, _snapshot(found.filter("category = 'Usage'"), AS_OF), [day], "as_of")
    return r2(out.groupBy("as_of").agg(F.count(F.lit(1)).alias("rows"), F.sum("annual_savings").alias("annual_savings")))


@query("S13_late_rows")
def _(spark, sf):
    """The look-back window pulled again, late rows included."""
    stored = _stored(tc.charges(spark, sf))
    start, end = nightly.lookback(AS_OF)
    pulled = files.date_range(stored.withColumnRenamed("charge_date", "ChargePeriodStart"), start, end, guard=False)
    windows = [{"key": b, "lo": start.isoformat(), "hi": (end - dt.timedelta(days=1)).isoformat()} for b in ("AWS", "Azure", "GCP", "OCI", "IBM Cloud")]
    before = stored.filter((F.col("charge_date") < F.lit(start)) | (F.col("charge_key") % 4 != 0))
    return _per_binding(sinks.replaced(before, pulled.withColumnRenamed("ChargePeriodStart", "charge_date").select(stored.columns),
                                       windows, "charge_date", "_binding"))


@query("S15_bindings_union")
def _(spark, sf):
    """All bindings in warehouse shape; one with an error in any month contributes nothing.

    An error of a month is one of some application in it, so verdicts and sums are one report, and no row meets its verdict in a join.
    """
    feed = tc.feed(spark, sf).drop("tag_application", "tag_business_unit", "tag_environment")
    rows = sinks.typed(nz.serialize_tags(nz.explode_tags(nz.normalize(feed))))
    report = va.verdict(rows.withColumn("month", cols.month()), ["_binding", "month", "tag_application"], more={"cost": F.sum(cols.COST)})
    per_tag = report.groupBy("_binding", "tag_application").agg(
        F.sum("row_count").alias("rows"), cols.total("cost").alias("cost"), F.bool_and("ok").alias("ok"))
    return per_tag.withColumn("ok", F.bool_and("ok").over(Window.partitionBy("_binding"))).filter("ok").drop("ok")


@query("S14_month_slices")
def _(spark, sf):
    ranges = tc.charges(spark, sf).groupBy(F.col("ProviderName").alias("binding")).agg(
        F.date_add(F.min(cols.day()), 9).alias("start"), F.date_add(F.max(cols.day()), 1).alias("end"))
    return files.month_slices(ranges)


@query("S16_issuer_stamp")
def _(spark, sf):
    c = tc.charges(spark, sf)
    empty = nz.stamp_issuer(c.withColumn("InvoiceIssuerName", F.lit(None).cast("string")), "Vendor")
    partly = nz.stamp_issuer(
        c.withColumn("InvoiceIssuerName", F.when(F.col("charge_key") % 2 == 0, "Given")), "Vendor")
    return (empty.select(F.lit("empty").alias("feed"), "InvoiceIssuerName")
            .union(partly.select(F.lit("partly"), "InvoiceIssuerName"))
            .groupBy("feed", "InvoiceIssuerName").agg(F.count(F.lit(1)).alias("rows")))


# --- normalise and validate ---------------------------------------------------------------
@query("N01_alias_rename")
def _(spark, sf):
    feed = tc.charges(spark, sf).select(
        F.col("ProviderName").alias("ServiceProviderName"), F.col("EffectiveCost").alias("AmortizedCost"),
        F.col("ChargeCategory").alias("ChargeType"), "ConsumedQuantity", F.lit(-1.0).alias("UsageQuantity"))
    return nz.rename_aliases(feed).groupBy("ProviderName", "ChargeCategory").agg(
        cols.total(cols.COST).alias("cost"), F.sum("ConsumedQuantity").alias("quantity"),
        F.sum("UsageQuantity").alias("extra"))


@query("N02_conform")
def _(spark, sf):
    full = nz.conform(tc.charges(spark, sf))
    counts = full.agg(*[F.count(c).alias(c) for c in full.columns])
    long = F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in full.columns]))
    return counts.select(long.alias("position", "e")).select(F.col("position").cast("bigint"), "e.*")


@query("N03_tolerant_cast")
def _(spark, sf):
    key = F.col("charge_key")
    text = tc.charges(spark, sf).select(
        "ProviderName",
        F.when(key % 7 == 0, "x").when(key % 7 == 1, "").otherwise(F.col("EffectiveCost").cast("string")).alias("EffectiveCost"),
        F.when(key % 5 == 0, "2001-02-31").when(key % 5 == 1, "soon")
        .otherwise(F.col("ChargePeriodStart").cast("string")).alias("ChargePeriodStart"))
    return nz.tolerant_cast(text).groupBy("ProviderName").agg(
        cols.total(cols.COST).alias("cost"), F.count("EffectiveCost").alias("costs"),
        F.count("ChargePeriodStart").alias("dates"), F.max("ChargePeriodStart").cast("date").alias("last"))


@query("N04_tag_key_fold")
def _(spark, sf):
    keys = F.explode(F.map_keys(F.from_json("Tags", "map<string,string>"))).alias("raw_key")
    raw = tc.charges(spark, sf).select(keys)
    return raw.groupBy("raw_key", nz.canonical_tag_key(F.col("raw_key")).alias("tag_key")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("N05_tag_explode")
def _(spark, sf):
    bare = tc.charges(spark, sf).drop("tag_application", "tag_business_unit", "tag_environment")
    return nz.explode_tags(bare).groupBy(*focus.TAG_COLUMNS).agg(F.count(F.lit(1)).alias("rows"))


@query("N06_tag_serialise")
def _(spark, sf):
    maps = tc.charges(spark, sf).select(F.from_json("Tags", "map<string,string>").alias("Tags"))
    return nz.serialize_tags(maps).groupBy("Tags").agg(F.count(F.lit(1)).alias("rows"))


def _issues(rule: str) -> Query:
    def run(spark, sf):
        found = va.issues(nz.normalize(tc.feed(spark, sf)), ["_binding"])
        return found.filter(F.col("rule") == rule)
    return run


@query("N07_missing_columns")
def _(spark, sf):
    return va.issues(tc.charges(spark, sf), ["ProviderName"]).filter("rule = 'missing_column'").select(
        "ProviderName", "severity", "column")


QUERIES["N08_null_errors"] = _issues("null")
QUERIES["N09_enum_errors"] = _issues("enum")
QUERIES["N11_subcategory_pairs"] = _issues("subcategory")
QUERIES["N12_recommended_null"] = _issues("all_null")


@query("N10_cross_column")
def _(spark, sf):
    found = va.issues(nz.normalize(tc.feed(spark, sf)), ["_binding"])
    return found.filter(F.col("rule").isin("purchase_usage_based", "commitment_type"))


@query("N13_verdict")
def _(spark, sf):
    feed = nz.normalize(tc.feed(spark, sf)).withColumn("month", cols.month())
    return va.verdict(feed, ["_binding", "month"])


# --- filters, projections, roll-ups -----------------------------------------------------------
@query("P01_scope_filter")
def _(spark, sf):
    scope = Scope(dt.date(2000, 3, 1), dt.date(2001, 3, 15), ("AWS", "Azure"), ("app-1", "app-2", "app-5"),
                  (), ("prod", "dr"))
    return scope.apply(tc.charges(spark, sf)).groupBy("ProviderName", "tag_application").agg(
        F.count(F.lit(1)).alias("rows"), cols.total(cols.COST).alias("cost"))


@query("P02_budget_scope")
def _(spark, sf):
    budgets = bu.budget_from_history(tc.charges(spark, sf))
    return r2(Scope(clouds=("AWS",), applications=("app-1", "app-2")).apply_budgets(budgets))


@query("P03_dimension_totals")
def _(spark, sf):
    names = [n for n in DIMENSIONS if n != "cost_center"]
    return ru.dimension_totals(tc.charges(spark, sf), names)


on_charges("P04_monthly_spend", ru.monthly)
on_charges("P05_monthly_by_dimension", lambda c: ru.monthly_by(c, "region"))
on_charges("P06_daily_spend", ru.daily)
on_charges("P07_daily_grain", lambda c: ru.daily_grain(c, "ServiceCategory"))
on_charges("P08_filter_values", ru.filter_values)


@query("P09_provenance")
def _(spark, sf):
    return va.provenance(nz.normalize(tc.feed(spark, sf)))


on_charges("P10_trailing_breakdown", lambda c: ru.trailing_breakdown(c, "service", 12, AS_OF))
on_charges("P11_top_and_other", lambda c: ru.fold_tail(ru.totals_by(c, "application"), "tag_application", 8).withColumn(
    "cost", F.col("cost").cast("double")))
on_charges("P12_dense_matrix", lambda c: ru.dense_matrix(c, "application"))
on_charges("P13_hierarchy", lambda c: ru.hierarchy(c, "cloud", "region"))
on_charges("P14_drill_down", lambda c: ru.drill_down(c, "application", "app-3"))
on_charges("P15_label_parts", lambda c: ru.label_parts(op.detect(c)))


# --- KPIs ---------------------------------------------------------------------------------------
on_charges("K01_total_spend", kpi.total_spend)
on_charges("K02_month_deltas", lambda c: r6(kpi.month_deltas(c), "mom_pct", "yoy_pct"))
on_charges("K03_latest_deltas", lambda c: r6(kpi.latest_deltas(c)))
on_charges("K04_burn_rate", lambda c: r2(kpi.burn_rate(c).select("burn_rate")))
on_charges("K05_run_rate", lambda c: r2(kpi.burn_rate(c).select("run_rate")))
on_charges("K06_commitment_coverage", lambda c: r6(kpi.commitment_coverage(c)))
on_charges("K07_commitment_utilisation", lambda c: r6(kpi.commitment_utilization(c)))
on_charges("K08_commitment_waste", lambda c: r6(kpi.commitment_waste(c), "commitment_waste_pct"))
on_charges("K09_on_demand_equivalent", kpi.on_demand_equivalent)
on_charges("K10_effective_savings_rate", lambda c: r6(kpi.effective_savings_rate(c, 1000.0)))
on_charges("K11_esr_components", lambda c: r6(kpi.esr_components(c)))
on_charges("K12_months_observed", lambda c: r6(kpi.months_observed(c)))


def _usage_waste(c: DataFrame):
    return op.usage_waste(op.detect(c, op.WASTE_DETECTORS)).scalar()


on_charges("K13_cost_of_waste", lambda c: r6(r2(kpi.cost_of_waste(c, _usage_waste(c)), "cost_of_waste"), "waste_pct"))
on_charges("K14_allocation_coverage", lambda c: r6(kpi.allocation_coverage(
    c, ["application", "business_unit", "environment"]).drop("readiness")))
on_charges("K15_chargeback_readiness", lambda c: kpi.allocation_coverage(c).select("tag_key", "readiness"))
on_charges("K16_unit_cost", lambda c: r6(kpi.unit_cost(c, 3600.0)))


@query("K17_unit_cost_series")
def _(spark, sf):
    return r6(kpi.unit_cost_series(tc.charges(spark, sf), tc.drivers(spark, sf), "orders"), "unit_cost")


@query("K18_variance_rows")
def _(spark, sf):
    c = tc.charges(spark, sf)
    sums = c.filter(cols.usage()).groupBy("ProviderName").agg(
        cols.total(cols.COST).alias("actual"), cols.total(cols.LIST).alias("budget"))
    return r6(kpi.with_variance(sums), "variance_abs", "variance_pct")


@query("K19_projected_year_end")
def _(spark, sf):
    start = F.col("ChargePeriodStart")
    mid, new_year = F.lit(dt.date(2001, 7, 1)), F.lit(dt.date(2001, 1, 1))
    sums = tc.charges(spark, sf).groupBy("ProviderName").agg(
        cols.total(cols.COST, (start >= new_year) & (start < mid)).alias("ytd"),
        cols.total(cols.COST, start >= mid).alias("remaining"),
        cols.total(cols.LIST, (start >= new_year) & (F.col("ProviderName") != "GCP")).alias("annual_budget"))
    return r6(kpi.with_projection(sums), "projected_spend", "variance_abs", "variance_pct")


def _naive_pairs(c: DataFrame) -> DataFrame:
    months = ru.monthly_by(c, "cloud")
    last = F.lag("cost").over(Window.partitionBy("ProviderName").orderBy("period"))
    return months.select("ProviderName", F.col("cost").alias("actual"), last.alias("forecast")).dropna()


on_charges("K20_accuracy", lambda c: r6(kpi.accuracy(_naive_pairs(c), ["ProviderName"])))
on_charges("K21_trailing_baseline", lambda c: r2(kpi.trailing_baseline(c)))
on_charges("K22_baseline_drift", lambda c: r6(kpi.baseline_drift(c)))
on_charges("K23_executive_summary", lambda c: executive(c))
on_charges("K24_commitment_position", lambda c: r6(kpi.commitment_position(c)))
on_charges("K25_maturity_band", lambda c: kpi.with_maturity(
    kpi.accuracy(_naive_pairs(c), ["ProviderName"])).select("ProviderName", "maturity"))


def executive(c: DataFrame) -> DataFrame:
    money = ["total_spend", "run_rate", "commitment_waste", "cost_of_waste"]
    row = r2(kpi.executive_summary(c, _usage_waste(c)), *money)
    return r6(row, *[n for n, t in row.dtypes if t == "double" and n not in money])


# --- allocation ------------------------------------------------------------------------------------
PROPORTIONAL = al.SharedCostPolicy()
FIXED = al.SharedCostPolicy("fixed_percentage", fixed_percentages={
    "BUILDING": 40.0, "MACHINERY": 30.0, "FURNITURE": 20.0, "Elsewhere": 10.0})
DRIVER = al.SharedCostPolicy("usage_driver", driver_metric="ConsumedQuantity")

on_charges("L02_row_classification", lambda c: al.classify(c, PROPORTIONAL))
on_charges("L03_shared_pool", lambda c: al.shared_pool(c, PROPORTIONAL))
on_charges("L04_direct_cost", lambda c: al.direct_costs(c, PROPORTIONAL))
on_charges("L05_weights_even", lambda c: r6(al.weights(c, al.SharedCostPolicy("even_split"))))
on_charges("L06_weights_proportional", lambda c: r6(al.weights(c, PROPORTIONAL, "ProviderName")))
on_charges("L07_weights_fixed", lambda c: r6(al.weights(c, FIXED)))
on_charges("L08_weights_driver", lambda c: r6(al.weights(c, DRIVER)))


def _allocated(df: DataFrame) -> DataFrame:
    return r6(r2(df, "shared_cost", "untagged_cost", "total_cost"), "pct_of_total", "shared_pct")


on_charges("L09_allocate", lambda c: _allocated(al.allocate(c, DRIVER, "tag_application")))
on_charges("L10_showback", lambda c: _allocated(al.showback(c)))
on_charges("L11_chargeback", lambda c: r2(al.chargeback(c, FIXED, period="2001-03")))
on_charges("L12_coverage_report", lambda c: r6(al.coverage_report(c), "coverage_pct"))
on_charges("L13_untagged_breakdown", lambda c: r6(al.untagged_breakdown(c), "pct_of_untagged"))
on_charges("L14_tag_governance", lambda c: r6(al.tag_governance(c), "coverage_pct"))
on_charges("L15_worst_tag", al.worst_tag)
on_charges("L16_tag_limits", al.tag_limit_violations)


def _history(c: DataFrame) -> DataFrame:
    return bu.with_history_budget(bu.monthly_report(c))


# --- budget -------------------------------------------------------------------------------------------
def _variance(by: list[str]) -> Callable[[DataFrame], DataFrame]:
    def run(c: DataFrame) -> DataFrame:
        # Planted beside the whole table: budgets of an application without actuals.
        rows = _history(c)
        again = (F.col("application") == "app-1") & (F.month("period") == 6) & F.col("budgeted")
        names = F.when(again, F.array(F.col("application"), F.lit("app-new"))).otherwise(F.array("application"))
        rows = rows.withColumn("name", F.explode(names)).withColumns({
            "actual": F.when(F.col("name").eqNullSafe(F.col("application")), F.col("actual")), "application": F.col("name")})
        return r6(r2(bu.variance_of(rows, by), "budget", "variance_abs"), "actual", "variance_pct")
    return run


on_charges("B01_monthly_actuals", bu.monthly_actuals)
on_charges("B02_variance_table", _variance(["cloud", "application", "period"]))
on_charges("B02b_variance_business_unit", lambda c: r6(r2(bu.variance_table(
    c, bu.budget_from_history(c), ["business_unit"]), "budget", "variance_abs"), "actual", "variance_pct"))


@query("B03_bridge")
def _(spark, sf):
    out = bu.variance_bridge(bu.variance_of(_history(tc.charges(spark, sf)), ["cloud"]), "cloud")
    return r2(out.withColumn("position", F.col("position").cast("bigint")))


@query("B04_year_end_projection")
def _(spark, sf):
    c = tc.charges(spark, sf)
    ahead = fc.forecast_points(ru.monthly(c), [], 6, "linear").select("period", F.col("yhat").alias("cost"))
    out = bu.year_end_of(_history(c), ahead, 4)
    return r6(r2(out, "projected_spend", "annual_budget", "variance_abs"), "variance_pct")


on_charges("B05_burn_down", lambda c: r6(r2(bu.burn_down_of(_history(c)), "cumulative_actual", "cumulative_budget"), "pace"))
on_charges("B06_run_rate_table", lambda c: r2(bu.run_rate_table(c)))
on_charges("B07_budget_from_history", lambda c: r2(bu.budget_from_history(c)))


# --- anomalies --------------------------------------------------------------------------------------------
def _events(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(tc.event_series(spark, sf))


EV = ["event_type"]
QUERIES["D01_rolling_median"] = _events(lambda s: r6(an.with_expected(s, EV).select("period", *EV, "cost", "expected")))
on_charges("D02_stl_substitute", lambda c: r6(an.with_expected(
    ru.daily_grain(c, "ServiceCategory"), ["ServiceCategory"]).select("period", "ServiceCategory", "expected")))
on_charges("D02_stl", lambda c: rounded(an.detect(
    ru.daily_grain(c, "ServiceCategory"), ["ServiceCategory"], "stl").select("period", "ServiceCategory", "expected", "is_anomaly"), 4, "expected"))
QUERIES["D03_zscore"] = _events(lambda s: r6(an.detect(s, EV, "zscore").select("period", *EV, "expected", "score")))
QUERIES["D04_mad"] = _events(lambda s: r6(an.detect(s, EV, "mad").select("period", *EV, "expected", "score")))
QUERIES["D05_dual_test"] = _events(lambda s: an.detect(s, EV, threshold=2.5, min_deviation_pct=20.0, min_cost=100.0)
                                   .select("period", *EV, "is_anomaly"))
QUERIES["D06_severity"] = _events(lambda s: an.detect(s, EV, threshold=2.0).groupBy(*EV, "severity").agg(
    F.count(F.lit(1)).alias("points")))
#: A series too short to score is planted beside the whole table.
QUERIES["D07_warm_up"] = _events(lambda s: an.detect(s.union(
    s.filter((F.col("event_type") == "error") & (F.dayofmonth("period") <= 9)).withColumn("event_type", F.lit("short"))), EV, threshold=1.0)
    .groupBy(*EV).agg(F.count_if("is_anomaly").alias("flagged"), F.count_if(F.col("score") != 0).alias("scored")))
QUERIES["D08_detect"] = _events(lambda s: r6(an.detect(s, EV)))
on_charges("D09_detect_by_dimension", lambda c: r6(an.detect_by_dimension(c, "ServiceCategory")))
on_charges("D10_summarise", lambda c: r6(an.summarise(an.detect_by_dimension(c, "ProviderName", threshold=2.5),
                                                      "ProviderName")))
on_charges("D11_report", lambda c: r6(an.report(an.detect_by_dimension(c, "ServiceName"), "ServiceName")))


# --- forecasts over provider x service category -------------------------------------------------------------
def history(c: DataFrame) -> DataFrame:
    return c.groupBy(*SERIES, cols.month().alias("period")).agg(F.sum(cols.COST).cast("double").alias("cost"))


def on_series(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    on_charges(name, lambda c: fn(history(c)))


def _model(method: str) -> Callable[[DataFrame], DataFrame]:
    digits = 6 if "naive" in method else 2  # naive points are exact sums

    def run(h: DataFrame) -> DataFrame:
        points = fc.forecast_points(h, SERIES, HORIZON, method).withColumn("step", F.col("step").cast("bigint"))
        return rounded(r2(points, "sigma"), digits, "yhat")
    return run


on_series("F01_prepare", lambda h: fc.prepare(h.withColumn("period", F.date_add("period", 3)), SERIES))
on_series("F02_future_periods", lambda h: h.groupBy(*SERIES).agg(F.max("period").alias("last")).select(
    *SERIES, F.explode(fc.future_periods(F.col("last"), HORIZON)).alias("period")))
on_series("F03_naive", _model("naive"))
on_series("F04_seasonal_naive", _model("seasonal_naive"))
on_series("F05_linear", _model("linear"))
on_series("F06_holt_winters_substitute", _model("holt_winters"))
on_series("F07_sarima_substitute", _model("sarima"))
on_series("F08_ensemble", _model("ensemble"))


def _seasonal(points: Callable[..., DataFrame], *parameters: str) -> Callable[[DataFrame], DataFrame]:
    def run(h: DataFrame) -> DataFrame:
        out = points(h, SERIES, HORIZON).withColumn("step", F.col("step").cast("bigint"))
        return rounded(r2(out, "sigma", "yhat"), 6, *parameters)
    return run


on_series("F06_holt_winters", _seasonal(sn.holt_winters, "alpha", "beta", "gamma", "phi"))
on_series("F07_seasonal_arima", _seasonal(sn.arima, "ar", "ma", "seasonal_ma"))
on_series("F09_residual_interval", lambda h: r2(fc.with_interval(
    fc.forecast_points(h, SERIES, HORIZON, "linear")).select(*SERIES, "period", "lo80", "hi80", "lo95", "hi95")))
on_series("F10_band_repair", lambda h: r2(r6(fc.repair_bands(fc.with_interval(
    fc.forecast_points(h, SERIES, HORIZON, "seasonal_naive"))).select(
    *SERIES, "period", "cost", "lo80", "hi80", "lo95", "hi95"), "cost"), "lo80", "hi80", "lo95", "hi95"))
on_series("F11_backtest", lambda h: r6(fc.backtest(h, SERIES, ["naive", "seasonal_naive", "linear", "ensemble"]).select(
    *SERIES, "method", "mape", "wape", "smape", F.col("folds").cast("bigint").alias("folds"))))
on_series("F12_auto_select", lambda h: r6(fc.auto_select(h, SERIES)))
on_series("F13_forecast_spend", lambda h: r2(fc.forecast_spend(h, SERIES, HORIZON)))
on_series("F13b_forecast_summary", lambda h: r6(fc.forecast_summary(h, SERIES).select(
    *SERIES, "method", F.col("n_history").cast("bigint").alias("n_history"), "wape", "maturity")))


def _overlay(c: DataFrame) -> DataFrame:
    return fc.commitment_expiry_overlay(c, fc.estate_forecast(c, 24, "linear"))


on_charges("F14_commitment_cliff", lambda c: r2(_overlay(c).select("period", "cost", "cost_with_cliffs", "cliff")))
on_charges("F15_driver_overlay", lambda c: r2(fc.driver_overlay(
    fc.estate_forecast(c, 8, "linear"),
    [{"period": "2001-12", "pct": 0.10, "label": "rollout"}, {"period": "soon", "pct": 1},
     {"period": "2002-03", "pct": -0.05}]).select(
    "period", "cost", "cost_adjusted", F.array_join("applied_drivers", "; ").alias("drivers"))))
on_charges("F16_cliff_summary", lambda c: fc.cliff_summary(_overlay(c)).withColumn(
    "cliff_months", F.array_join("cliff_months", ",")))


# --- optimisation ----------------------------------------------------------------------------------------------
O_NAMES = {
    "O01": "commitment_gap", "O02": "commitment_waste", "O03": "idle", "O04": "gp2_volumes", "O05": "previous_generation",
    "O06": "nonprod_always_on", "O07": "spot_candidates", "O08": "arm_migration", "O09": "licence_included",
    "O10": "storage_tiering", "O11": "ai_growth", "O12": "untagged_flag",
}
O_COLUMNS = ["lever_id", "lever_name", "category", "cloud", "scope", "monthly_savings", "annual_savings", "effort",
             "risk", "time_to_value", "confidence", "resource_count"]

for _id, _slug in O_NAMES.items():
    on_charges(f"{_id}_{_slug}", lambda c, d=_id: op.detect(c, [d]).select(*O_COLUMNS))
on_charges("O13_detect_all", lambda c: op.detect(c).select(*O_COLUMNS))


on_charges("O14_idle_examples", lambda c: op.idle_examples(c).select(
    "ResourceType", F.size("resource_ids").cast("bigint").alias("resources"), F.array_join("resource_ids", ",").alias("resource_ids")))


@query("O14_snapshot_rows")
def _(spark, sf):
    rows = op.snapshot(op.detect(tc.charges(spark, sf)), AS_OF, dt.datetime(2001, 9, 30, 3, 45))
    spend = F.get_json_object("evidence", "$.spend").cast("double")
    return rows.select("as_of", "lever_id", "cloud", "scope", F.col("monthly_savings").cast("double"),
                       F.col("annual_savings").cast("double"), F.round(spend, 1).alias("evidence_spend"),
                       "resource_count")


on_charges("O15_filtered", lambda c: op.count_and_total(op.filtered(op.detect(c), " usage", 400000.0)))
on_charges("O16_usage_waste", lambda c: r2(op.usage_waste(op.detect(c, op.WASTE_DETECTORS))))
on_charges("O17_savings_by_category", lambda c: r2(op.savings_by_category(op.detect(c))))
on_charges("O18_roadmap", lambda c: r2(op.roadmap(op.detect(c)).withColumn("wave", F.col("wave").cast("bigint")),
                                       "cumulative_annual_savings"))
on_charges("O20_esr_uplift", lambda c: op.esr_uplift(c, op.detect(c)))


@query("O19_levers_in_use")
def _(spark, sf):
    """The catalogue entries the estate's opportunities refer to."""
    used = op.detect(tc.charges(spark, sf)).groupBy(F.col("lever_id").alias("id")).agg(
        F.count(F.lit(1)).alias("opportunities"))
    return levers.catalog(spark).join(used, "id")
