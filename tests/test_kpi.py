import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendframe.operators import kpi, rollups as ru
from spendframe.operators.scope import Scope, dimension, months_back


def test_deltas_count_present_months(charges, one):
    rows = [dict(day=f"2023-{m:02d}-01", EffectiveCost=float(m)) for m in range(1, 13)] + [dict(day="2024-03-01", EffectiveCost=24.0)]
    out = one(kpi.latest_deltas(charges(*rows)))
    assert out["mom_pct"] == pytest.approx(100.0) and out["yoy_pct"] == pytest.approx(2300.0)


def test_deltas_need_history_and_a_prior(charges, one):
    assert one(kpi.latest_deltas(charges(dict()))) == {"mom_pct": None, "yoy_pct": None}
    zero = charges(dict(day="2024-01-01", EffectiveCost=0.0), dict(day="2024-02-01"))
    assert one(kpi.latest_deltas(zero))["mom_pct"] is None


def test_empty_scope(charges, one):
    none = charges(dict()).filter("ProviderName = 'nobody'")
    assert one(kpi.total_spend(none)) == {"total_spend": 0.0}
    out = one(kpi.executive_summary(none))
    assert out["total_spend"] == 0.0 and out["run_rate"] is None and out["esr_pct"] is None
    assert out["chargeback_readiness"] == "Unknown"
    assert one(kpi.months_observed(none))["months_observed"] == 1.0


def test_coverage_counts_unpriced_but_not_dynamic(charges, one):
    df = charges(dict(PricingCategory=None, CommitmentDiscountId="c"), dict(PricingCategory="Dynamic"), dict(),
                 dict(ServiceCategory="Storage"), dict(ChargeCategory="Tax"))
    assert one(kpi.commitment_coverage(df))["coverage_pct"] == pytest.approx(50.0)


def test_waste_needs_the_commitment_id(charges, one):
    df = charges(dict(CommitmentDiscountStatus="Unused"), dict(CommitmentDiscountId="c", CommitmentDiscountStatus="Unused", EffectiveCost=30.0),
                 dict(CommitmentDiscountId="c", CommitmentDiscountStatus="Used", EffectiveCost=70.0))
    out = one(kpi.commitment_waste(df))
    assert (out["commitment_waste"], out["commitment_waste_pct"]) == (30.0, pytest.approx(30.0))
    assert one(kpi.commitment_utilization(df))["utilization_pct"] == pytest.approx(70.0)


def test_baseline_divides_by_the_window(charges, one):
    df = charges(dict(day="2024-01-01"), dict(day="2024-04-01", EffectiveCost=90.0), dict(day="2024-03-31", EffectiveCost=90.0))
    assert one(kpi.trailing_baseline(df))["baseline"] == pytest.approx(2.0)  # 2024-01-02 is the first day inside
    assert one(kpi.baseline_drift(df))["baseline_drift_pct"] == pytest.approx(200.0)


def test_summary_agrees_with_single_kpis(spark, one):
    from spendframe.sources import testcharges as tc
    c = tc.charges(spark, "/root/testdata/sf0.001")
    s = one(kpi.executive_summary(c, 10.0))
    singles = {}
    for fn in (kpi.total_spend, kpi.latest_deltas, kpi.burn_rate, kpi.effective_savings_rate, kpi.commitment_coverage,
               kpi.commitment_utilization, kpi.commitment_waste, kpi.baseline_drift):
        singles |= one(fn(c))
    for name in set(s) & set(singles):
        assert s[name] == pytest.approx(singles[name])
    months = one(kpi.months_observed(c))["months_observed"]
    assert s["cost_of_waste"] == pytest.approx(s["commitment_waste"] + 10.0 * months)


def test_accuracy_skips_zeros(spark, one):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (10.0, 5.0)], "actual double, forecast double")
    out = one(kpi.accuracy(df))
    assert out["mape"] == pytest.approx(50.0) and out["wape"] == pytest.approx(100.0)
    assert out["smape"] == pytest.approx((200.0 + 100 * 5 / 7.5) / 2)
    zero = spark.createDataFrame([(0.0, 1.0)], "actual double, forecast double")
    assert one(kpi.accuracy(zero))["wape"] is None


def test_unit_cost_series(charges, spark):
    drivers = spark.createDataFrame([(dt.date(2024, 1, 1), "m", 0.0), (dt.date(2024, 2, 1), "m", 4.0), (dt.date(2024, 2, 1), "x", 1.0)],
                                    "period date, metric string, value double")
    df = charges(dict(day="2024-01-05"), dict(day="2024-02-05"), dict(day="2024-03-05"))
    out = {r["period"].month: r["unit_cost"] for r in kpi.unit_cost_series(df, drivers, "m").collect()}
    assert out == {1: None, 2: 25.0}


@pytest.mark.parametrize("pct,status", [(10.1, "critical"), (10.0, "serious"), (2.0, "good"), (-10.0, "good"), (-10.1, "warning")])
def test_variance_status(spark, one, pct, status):
    df = spark.createDataFrame([(100.0 + pct, 100.0)], "actual double, budget double")
    out = one(kpi.with_variance(df.withColumn("actual", F.round("actual", 6))))
    assert out["status"] == status


def test_scope(charges):
    df = charges(dict(day="2024-01-01"), dict(day="2024-01-31", ProviderName="GCP"), dict(day="2024-02-01"))
    assert Scope(dt.date(2024, 1, 1), dt.date(2024, 1, 31)).apply(df).count() == 2
    assert Scope(clouds=("GCP",)).apply(df).count() == 1
    assert Scope().bounded(dt.date(2024, 3, 31)).start == dt.date(2022, 2, 28)
    assert months_back(dt.date(2024, 3, 31), 1) == dt.date(2024, 2, 29)


def test_dimension_whitelist():
    assert dimension(" Cloud ") == "ProviderName" and dimension("RegionId") == "RegionId"
    for bad in ("", "1; drop table x", "EffectiveCost"):
        with pytest.raises(ValueError):
            dimension(bad)


def test_fold_tail(charges):
    labels = [dict(tag_application=f"a{i}", EffectiveCost=float(i)) for i in range(1, 10)]
    out = {r["tag_application"]: float(r["cost"]) for r in ru.fold_tail(ru.totals_by(charges(*labels), "application"), "tag_application", limit=8).collect()}
    assert len(out) == 8 and out["Other"] == 3.0 and out["a9"] == 9.0
    same = ru.fold_tail(ru.totals_by(charges(*labels[:8]), "application"), "tag_application", limit=8)
    assert {r[0] for r in same.collect()} == {f"a{i}" for i in range(1, 9)}


def test_dense_matrix_fills_gaps(charges):
    df = charges(dict(day="2024-01-01", tag_application="a"), dict(day="2024-03-01", tag_application="b", EffectiveCost=5.0))
    out = {(r[0], r[1].month): r[2] for r in ru.dense_matrix(df, "application").collect()}
    assert out == {("a", 1): 100.0, ("a", 3): 0.0, ("b", 1): 0.0, ("b", 3): 5.0}


def test_day_grain_only(charges):
    df = charges(dict(day="2024-01-01"), dict(day="2024-01-01", end="2024-01-03"), dict(day="2024-01-01", end="2024-02-01"))
    assert ru.daily_grain(df).first()["cost"] == 200.0
