import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendframe.operators import kpi, levers, optimize as op
from spendframe.sources import testcharges as tc


def found(df, *detectors):
    return {(r["detector"], r["lever_id"], r["cloud"]): r for r in op.detect(df, list(detectors) or op.DETECTORS).collect()}


def test_commitment_gap_takes_the_trailing_floor(charges):
    rows = [dict(day=f"2024-{m:02d}-01", ListCost=1000.0 + m, ResourceId=f"r{m % 2}") for m in range(1, 9)]
    rows.append(dict(day="2024-02-01", ListCost=-900.0))  # before the last six months
    out = found(charges(*rows, dict(ProviderName="IBM Cloud", ListCost=5000.0)), "O01")
    assert set(out) == {("O01", "R1", "AWS")}
    row = out["O01", "R1", "AWS"]
    assert (row["monthly_savings"], row["resource_count"]) == (round(1003 * 0.31, 2), 3)
    assert row["evidence"]["months_observed"] == "6"


def test_months_divide_by_the_whole_frame(charges):
    df = charges(dict(CommitmentDiscountId="c", CommitmentDiscountStatus="Unused", EffectiveCost=300.0),
                 dict(day="2024-02-01", ChargeCategory="Tax", ProviderName="GCP", EffectiveCost=0.0))
    assert found(df, "O02")["O02", "R21", "AWS"]["monthly_savings"] == 150.0


def test_floor_of_fifty_dollars(charges):
    idle = dict(ConsumedQuantity=0.0, ResourceType="Volume")
    assert found(charges(dict(idle, EffectiveCost=49.99)), "O03") == {}
    assert len(found(charges(dict(idle, EffectiveCost=50.0)), "O03")) == 1


def test_idle_types_span_clouds(charges):
    rows = [dict(ConsumedQuantity=0.0, ResourceType=t, ProviderName=p, ResourceId="same")
            for t in op.IDLE_LEVERS for p in ("GCP", "AWS", "Private")]
    out = found(charges(*rows, dict(ConsumedQuantity=0.0, ResourceType="Other")), "O03")
    assert {k[1] for k in out} == {"U4", "U5", "U6", "U7", "U8"}
    assert {k[2] for k in out} == {"AWS, GCP, Private"}
    assert {r["resource_count"] for r in out.values()} == {1}
    idle = charges(*[dict(ConsumedQuantity=0.0, ResourceType="Volume", ResourceId=f"v{i}") for i in range(9)])
    assert op.idle_examples(idle).first()["resource_ids"] == [f"v{i}" for i in range(9)]
    assert op.idle_examples(idle, 5).first()["resource_ids"] == ["v0", "v1", "v2", "v3", "v4"]


def test_always_on_keeps_every_month_of_a_resource(charges):
    base = dict(tag_environment="dev", EffectiveCost=100.0)
    df = charges(dict(base, ConsumedQuantity=400.0), dict(base, day="2024-01-02", ConsumedQuantity=248.0),
                 dict(base, day="2024-02-01", ConsumedQuantity=1.0), dict(base, ResourceId="r-2", ConsumedQuantity=647.0))
    row = found(df, "O06")["O06", "U10", "AWS"]
    assert (row["monthly_savings"], row["resource_count"]) == (round(300 / 2 * 0.65, 2), 1)


def test_unknown_cloud_gets_only_neutral_levers(spark):
    c = tc.charges(spark, "/root/testdata/sf0.001").withColumn("ProviderName", F.lit("Private"))
    assert {k[0] for k in found(c)} <= {"O02", "O03", "O04", "O05", "O06", "O09", "O11", "O12"}
    assert {"O02", "O03", "O09", "O12"} <= {k[0] for k in found(c)}


def test_sku_rules(charges):
    rows = [dict(SkuId=s, EffectiveCost=1000.0, ResourceId=s) for s in
            ("m4.large", "t2.micro", "n1-std", "x_v2", "VM.Standard2.1", "m7g.large", "VM.Standard.A1.Flex", None, "m5-gp2")]
    out = found(charges(*rows), "O04", "O05", "O08", "O09")
    assert out["O05", "U17", "AWS"]["monthly_savings"] == 5000 * 0.125
    assert out["O08", "R14", "AWS"]["monthly_savings"] == pytest.approx(7000 * 0.07)  # a null sku counts as x86
    assert out["O04", "U15", "AWS"]["monthly_savings"] == 200.0
    assert ("O09", "R12", "AWS") not in out


def test_ai_growth(charges):
    ai = dict(ServiceCategory="AI and Machine Learning")
    rows = [dict(ai, day=f"2024-{m:02d}-01", EffectiveCost=1000.0 * 1.2 ** m, ProviderName="GCP") for m in range(1, 5)]
    out = found(charges(*rows), "O11")
    assert {k[1] for k in out} == {"G3", "G4"}  # the third lever is AWS only
    assert out["O11", "G3", "GCP"]["scope"].startswith("AI/ML spend growing 20%/mo -- Model routing")
    assert found(charges(*rows[:2]), "O11") == {}
    flat = [dict(r, EffectiveCost=1000.0) for r in rows]
    assert found(charges(*flat), "O11") == {}


def test_untagged_flag_survives_the_floor(charges):
    df = charges(dict(tag_application="Unallocated", EffectiveCost=25.0), dict(EffectiveCost=75.0))
    row = found(df, "O12")["O12", "U18", "AWS"]
    assert row["monthly_savings"] == 0.0 and row["evidence"]["share_of_usage_pct"] == "25.0"
    assert found(charges(dict()), "O12") == {}


def test_estate_properties(spark, one):
    c = tc.charges(spark, "/root/testdata/sf0.001").persist()
    opps = op.detect(c).persist()
    rows = opps.collect()
    assert len({r["lever_id"] for r in rows}) >= 8
    assert all(r["annual_savings"] == pytest.approx(12 * r["monthly_savings"]) for r in rows)
    unused = one(kpi.commitment_waste(c))["commitment_waste"]
    months = c.select(F.trunc("ChargePeriodStart", "month")).distinct().count()
    assert sum(r["monthly_savings"] for r in rows if r["lever_id"] == "R21") * months == pytest.approx(unused, abs=months)
    plan = op.roadmap(opps).orderBy("wave", F.desc("annual_savings"), "lever_id", "cloud", "scope").collect()
    running = [r["cumulative_annual_savings"] for r in plan]
    assert running == sorted(running) and plan[0]["wave"] == 1
    assert one(op.usage_waste(opps))["usage_waste_monthly"] == pytest.approx(
        sum(r["monthly_savings"] for r in rows if r["lever_id"] in op.WASTE_LEVERS))
    snap = op.snapshot(opps, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 3))
    assert snap.count() == len(rows) and snap.columns[0] == "as_of" and len(snap.columns) == 15
    assert one(op.count_and_total(op.filtered(opps, "nothing")))["count"] == 0


def test_single_detectors_agree_with_all(spark):
    c = tc.charges(spark, "/root/testdata/sf0.001").persist()
    everything = {k: r["monthly_savings"] for k, r in found(c).items()}
    for d in ("O01", "O03", "O06", "O11"):
        assert {k: r["monthly_savings"] for k, r in found(c, d).items()} == {k: v for k, v in everything.items() if k[0] == d}


def test_uplift_without_on_demand_spend(charges, one):
    df = charges(dict(ListCost=0.0))
    assert one(op.esr_uplift(df, op.detect(df))) == {
        "current_esr_pct": None, "projected_esr_pct": None, "uplift_pts": 0.0, "rate_savings_annual": 0.0}


def test_catalogue(spark):
    rows = levers.catalog(spark).collect()
    assert len({r["id"] for r in rows}) == len(rows) == 59
    assert all(0 <= r["savings_low"] <= r["savings_high"] <= 1 for r in rows)
    assert {lever for p in levers.PROFILES.values() for lever in (p[1], p[3], p[4])} <= {r["id"] for r in rows}
    assert levers.lookup(spark, " u10 ").first()["name"] == "Schedule / park non-prod"
    assert levers.lookup(spark, "zz").count() == 0
    details = spark.createDataFrame([("U10", "idle nights")], "id string, prerequisites string")
    assert levers.lookup(spark, "U10", details).first()["prerequisites"] == "idle nights"
