import datetime as dt

import pytest

from spendframe.operators import allocation as al, budget as bu
from spendframe.sources import testcharges as tc


@pytest.fixture
def estate(charges):
    return charges(
        dict(tag_business_unit="a", EffectiveCost=60.0), dict(tag_business_unit="b", EffectiveCost=20.0),
        dict(tag_business_unit="a", ServiceCategory="Security", EffectiveCost=8.0),
        dict(tag_business_unit="Unallocated", EffectiveCost=10.0), dict(tag_business_unit=None, EffectiveCost=2.0),
        dict(tag_business_unit="Unallocated", tag_application="Shared Platform Services", EffectiveCost=4.0))


@pytest.mark.parametrize("policy", [
    al.SharedCostPolicy(), al.SharedCostPolicy("even_split"), al.SharedCostPolicy("direct"),
    al.SharedCostPolicy("fixed_percentage", fixed_percentages={"a": 30.0, "b": 60.0}),
    al.SharedCostPolicy("usage_driver", driver_metric="ConsumedQuantity")])
@pytest.mark.parametrize("dim", ["tag_business_unit", "ProviderName", "tag_application"])
def test_totals_reconcile(estate, policy, dim):
    rows = al.allocate(estate, policy, dim).collect()
    assert sum(r["total_cost"] for r in rows) == pytest.approx(104.0)
    assert sum(r["pct_of_total"] for r in rows) == pytest.approx(100.0)


def test_fixed_percentages_are_renormalised(estate):
    policy = al.SharedCostPolicy("fixed_percentage", fixed_percentages={"a": 30.0, "b": 60.0})
    got = {r[0]: r["weight"] for r in al.weights(estate, policy).collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": pytest.approx(2 / 3)}


def test_zero_direct_spend_splits_evenly(charges):
    df = charges(dict(tag_business_unit="a", EffectiveCost=0.0), dict(tag_business_unit="b", EffectiveCost=0.0),
                 dict(tag_business_unit="Unallocated"))
    assert [r["untagged_cost"] for r in al.allocate(df, al.SharedCostPolicy()).collect()] == [50.0, 50.0]


def test_direct_without_pools(estate):
    rows = al.allocate(estate, al.SharedCostPolicy("direct", spread_pools=False)).collect()
    assert sum(r["total_cost"] for r in rows) == pytest.approx(80.0)


def test_chargeback_lines(estate):
    policy = al.SharedCostPolicy(include_untagged=False)
    lines = al.chargeback(estate, policy, period="2024-01").collect()
    assert {r["line_item"] for r in lines} == {"Direct", "Shared allocation"}
    assert al.chargeback(estate, policy, period="2024-02").count() == 0
    full = al.chargeback(estate, al.SharedCostPolicy()).collect()
    assert sum(r["amount"] for r in full) == pytest.approx(104.0)


def test_policy_problems():
    assert al.SharedCostPolicy().problems() == []
    assert len(al.SharedCostPolicy("magic").problems()) == 1
    assert al.SharedCostPolicy("fixed_percentage").problems()
    assert al.SharedCostPolicy("usage_driver").problems()


def test_tag_limits(charges):
    tags = '{"App": "' + "x" * 64 + '"}'
    df = charges(dict(ProviderName="GCP", Tags=tags), dict(ProviderName="AWS", Tags=tags),
                 dict(ProviderName="AWS", Tags="{" + ", ".join(f'"k{i}": "v"' for i in range(51)) + "}"))
    got = {(r[0], r[1]): r[2] for r in al.tag_limit_violations(df).collect()}
    assert got == {("GCP", "value_too_long"): 1, ("GCP", "not_lowercase"): 1, ("AWS", "too_many_tags"): 1}


def budgets(spark, *rows):
    return spark.createDataFrame([(dt.date.fromisoformat(p), c, a, b) for p, c, a, b in rows],
                                 "period date, cloud string, application string, budget double")


def test_variance_is_a_full_outer_join(charges, spark):
    df = charges(dict(), dict(ProviderName="GCP"), dict(ChargeCategory="Tax"))
    plan = budgets(spark, ("2024-01-09", "AWS", "app", 90.0), ("2024-01-01", "OCI", "app", 5.0), ("2024-01-01", "Zero", "app", 0.0))
    got = {r["cloud"]: (r["actual"], r["budget"], r["status"]) for r in bu.variance_table(df, plan, ["cloud"]).collect()}
    assert got == {"AWS": (100.0, 90.0, "critical"), "GCP": (100.0, 0.0, "unknown"), "OCI": (0.0, 5.0, "warning"),
                   "Zero": (0.0, 0.0, "unknown")}
    by_unit = bu.variance_table(df, plan, ["business_unit"]).collect()
    assert [(r["budget"], r["status"]) for r in by_unit] == [(0.0, "unknown")]


def test_burn_down_is_a_left_join(charges, spark):
    df = charges(dict(day="2024-01-01"), dict(day="2024-02-01"))
    plan = budgets(spark, ("2024-02-01", "AWS", "app", 50.0), ("2024-03-01", "AWS", "app", 1.0))
    got = [(r["cumulative_actual"], r["cumulative_budget"], r["pace"]) for r in bu.burn_down(df, plan).orderBy("period").collect()]
    assert got == [(100.0, 0.0, None), (200.0, 50.0, 4.0)]


def test_year_end_in_the_tail_of_a_fiscal_year(charges, spark, one):
    df = charges(dict(day="2023-06-01", EffectiveCost=7.0), dict(day="2023-07-01"), dict(day="2024-02-01"))
    ahead = spark.createDataFrame([(dt.date(2024, m, 1), 10.0) for m in (2, 3, 6, 7)], "period date, cost double")
    plan = budgets(spark, ("2023-06-01", "AWS", "app", 1.0), ("2023-07-01", "AWS", "app", 200.0))
    out = one(bu.year_end_projection(df, plan, ahead, 7))
    assert (out["projected_spend"], out["annual_budget"], out["months_remaining"]) == (220.0, 200.0, 2)
    assert out["variance_pct"] == pytest.approx(10.0)


def test_bridge(spark):
    drivers = spark.createDataFrame([(1, "new", 5.0), (2, "old", -2.0)], "position int, label string, delta double")
    total = spark.createDataFrame([(10.0,)], "budget double")
    got = [(r["label"], r["delta"], r["level"]) for r in bu.bridge(total, drivers).orderBy("position").collect()]
    assert got == [("Budget", 10.0, 10.0), ("new", 5.0, 15.0), ("old", -2.0, 13.0), ("Forecast", 13.0, 13.0)]


def test_run_rate_uses_one_elapsed_count(charges):
    df = charges(dict(day="2024-01-31"), dict(day="2024-02-01", ProviderName="GCP"), dict(day="2024-02-10", EffectiveCost=50.0))
    got = {r["cloud"]: (r["mtd"], r["burn_rate_daily"]) for r in bu.run_rate_table(df).collect()}
    assert got == {"GCP": (100.0, 10.0), "AWS": (50.0, 5.0)}


def test_allocation_over_the_estate(spark):
    c = tc.charges(spark, "/root/testdata/sf0.001")
    whole = float(c.groupBy().sum("EffectiveCost").first()[0])
    for dim in ("tag_business_unit", "tag_application", "RegionId"):
        assert sum(r["total_cost"] for r in al.showback(c, dim).collect()) == pytest.approx(whole)
