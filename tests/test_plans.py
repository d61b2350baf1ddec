"""Shapes the plans must keep over the partitioned charge table."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from spendframe.operators import (
    allocation as al, anomaly as an, budget as bu, forecast as fc, kpi, optimize as op, rollups as ru, validate as va,
)
from spendframe.operators.scope import Scope
from spendframe.plans import nightly, sinks
from spendframe.plans.queries import QUERIES
from spendframe.sources import payloads, testcharges as tc, warehouse as wh
from tests.conftest import SF


@pytest.fixture(autouse=True, scope="module")
def long_plans(spark):
    for key in ("spark.sql.maxMetadataStringLength", "spark.sql.debug.maxToStringFields"):
        spark.conf.set(key, 100000)
    yield
    for key in ("spark.sql.maxMetadataStringLength", "spark.sql.debug.maxToStringFields"):
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("wh") / "charges")
    rows = tc.feed(spark, SF).drop("tag_application", "tag_business_unit", "tag_environment", "_binding")
    rows = rows.filter("ChargePeriodStart >= '2001-06-01'")
    sinks.replace_charges(spark, nightly.prepare(rows, "b", dt.datetime(2001, 9, 30)), target)
    return target


@pytest.fixture
def charges(spark, path):
    return wh.read_charges(spark, path, Scope(dt.date(2001, 7, 1)), dt.date(2001, 9, 30))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan parquet", plan(df)))


def ran(df):
    """The plan as it ran, without the plans adaptive execution started from."""
    df.collect()
    out, skip = [], None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth >= skip and line.strip(" :+-"):
            continue
        skip = depth if "== Initial Plan ==" in line else None
        out.append(line)
    return "\n".join(out)


ALL = {
    "summary": kpi.executive_summary, "deltas": kpi.latest_deltas, "baseline": kpi.baseline_drift,
    "matrix": lambda c: ru.dense_matrix(c, "application"), "filters": ru.filter_values, "fold": lambda c: ru.fold_tail(ru.totals_by(c, "cloud"), "ProviderName", 3),
    "hierarchy": lambda c: ru.hierarchy(c, "cloud", "application"), "allocate": lambda c: al.allocate(c, al.SharedCostPolicy()),
    "governance": al.tag_governance, "untagged": al.untagged_breakdown, "run_rate": bu.run_rate_table,
    "anomalies": an.detect_by_dimension, "forecast": fc.estate_forecast, "cliffs": fc.commitment_steps, "detect": op.detect,
    "roadmap": lambda c: op.roadmap(op.detect(c)),
}


@pytest.mark.parametrize("name", list(ALL))
def test_one_pruned_scan_without_python_or_cross_join(charges, name):
    text = ran(ALL[name](charges))
    assert len(re.findall(r"FileScan parquet", text)) == 1, text
    assert "PartitionFilters: [isnotnull(charge_date" in text
    assert not re.search(r"Cartesian|NestedLoop|Python|ArrowEval", text)
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text)[1].count(":")
    assert columns <= 15, columns  # of 65


def test_filters_reach_the_scan(charges):
    text = plan(ru.drill_down(charges, "application", "app-1"))
    assert "EqualTo(tag_application,app-1)" in text
    assert "GreaterThanOrEqual(ChargePeriodStart" in text


def test_facts_are_aggregated_before_the_first_shuffle(charges):
    """Below every exchange nearest the scan there is a partial aggregate."""
    for name in ("summary", "matrix", "allocate", "anomalies", "detect", "filters"):
        lines = plan(ALL[name](charges)).splitlines()
        below = lines[max(i for i, line in enumerate(lines) if re.search(r"Exchange (hash|Single)", line)) + 1:]
        assert any("HashAggregate(keys" in line for line in below), name


def test_detectors_need_few_shuffles(charges):
    text = plan(op.detect(charges))
    wide = [line for line in text.splitlines() if re.search(r"Exchange (hash|range|Single)", line)]
    assert len(wide) <= 6, wide


def test_forecast_shuffles_do_not_grow_with_models(charges):
    history = ru.monthly_by(charges, "cloud")
    shuffles = {len(re.findall(r"Exchange hashpartitioning", plan(fc.forecast_spend(history, ["ProviderName"], 6, m))))
                for m in ("naive", "auto")}
    assert shuffles == {3}  # report, month sums, one row per series


def test_series_windows_share_one_shuffle(spark):
    out = an.detect(tc.event_series(spark, SF), ["event_type"])
    assert len(re.findall(r"Exchange hashpartitioning", plan(out))) == 2


FIXED = al.SharedCostPolicy("fixed_percentage", fixed_percentages={"BUILDING": 100.0})
DRIVER = al.SharedCostPolicy("usage_driver", driver_metric="ConsumedQuantity")


def history(c):
    return bu.with_history_budget(bu.monthly_report(c))


#: Reports with totals, budgets or ranks beside their rows.
REPORTS = {
    "even": lambda c: al.weights(c, al.SharedCostPolicy("even_split")), "proportional": lambda c: al.weights(c, al.SharedCostPolicy()),
    "fixed": lambda c: al.weights(c, FIXED), "driver": lambda c: al.weights(c, DRIVER), "showback": al.showback,
    "allocate": lambda c: al.allocate(c, DRIVER, "tag_application"), "chargeback": lambda c: al.chargeback(c, FIXED),
    "untagged": al.untagged_breakdown, "breakdown": lambda c: ru.trailing_breakdown(c, "service", 2, dt.date(2001, 9, 30)),
    "fold": lambda c: ru.fold_tail(ru.totals_by(c, "cloud"), "ProviderName", 3), "matrix": lambda c: ru.dense_matrix(c, "application"),
    "baseline": kpi.trailing_baseline, "drift": kpi.baseline_drift, "summary": kpi.executive_summary, "provenance": va.provenance,
    "budget": bu.budget_from_history, "variance": lambda c: bu.variance_of(history(c), ["cloud", "application", "period"]),
    "bridge": lambda c: bu.variance_bridge(bu.variance_of(history(c), ["cloud"]), "cloud"),
    "burn_down": lambda c: bu.burn_down_of(history(c)),
}


@pytest.mark.parametrize("name", list(REPORTS))
def test_reports_plan_one_scan(charges, name):
    """In the plan itself, so nothing hangs on exchanges that are reused at run time."""
    text = plan(REPORTS[name](charges))
    assert len(re.findall(r"FileScan parquet", text)) == 1 and "Subquery" not in text, text


def test_the_overlay_makes_the_forecast_once(charges):
    ahead = fc.forecast_points(ru.monthly(charges), [], 6, "linear").select("period", F.col("yhat").alias("cost"))
    assert scans(fc.commitment_expiry_overlay(charges, ahead)) == 2  # the forecast and the purchases


def test_no_window_over_labels_targets_or_starts(charges):
    for name in ("matrix", "fold", "allocate", "untagged", "baseline", "summary"):
        for line in plan(ALL[name](charges)).split("Window [")[1:]:
            assert "SinglePartition" not in line, name


def test_validation_is_grouped(charges):
    text = plan(va.verdict(charges.withColumn("m", F.lit(1)), ["_binding"]))
    assert not re.search(r"Cartesian|Python", text)


def test_writes_split_hot_partitions(spark, path):
    rows = wh.table(spark, path).drop("charge_date")
    assert "REBALANCE" in plan(sinks.laid_out(rows))


def test_detectors_sum_before_they_multiply_rows(charges):
    text = plan(op.detect(charges))
    assert scans(op.detect(charges)) == 1
    # Read upwards from the scan: the first exchange comes before any Generate.
    below = text[:text.index("FileScan parquet")]
    assert "Generate" not in below[below.rindex("Exchange"):]


def test_issues_read_the_rows_once(charges):
    df = charges.drop("InvoiceIssuerName")
    for keys in ([], ["ProviderName"]):
        assert scans(va.issues(df, keys)) == 1
    assert {r["rule"] for r in va.issues(df.limit(0)).collect()} == {"missing_column"}


def test_bindings_union_reads_the_feed_once(spark):
    """Verdicts and sums are one report: no second scan of a table, and no charge row meets its binding's verdict in a join."""
    df = QUERIES["S15_bindings_union"](spark, SF)
    assert scans(df) == len(tc.TABLES) and "LeftAnti" not in plan(df)


def test_finout_parses_a_cell_once(spark):
    """What compares a measure or falls back on it doesn't parse its cell again."""
    docs = spark.createDataFrame([([{"amortizedCost_sum": '{"amount": 2}', "listCost_sum": "0"}, {"amortizedCost_sum": "3", "listCost_sum": '{"amount": 4}'}],)],
                                 "data array<map<string,string>>")
    costs = payloads.finout(docs, dt.date(2024, 1, 1), dt.date(2024, 2, 1)).select("BilledCost", "EffectiveCost", "ListCost")
    assert [tuple(r) for r in costs.collect()] == [(2.0, 2.0, 2.0), (3.0, 3.0, 4.0)]
    assert plan(costs).count("get_json_object") == 3
