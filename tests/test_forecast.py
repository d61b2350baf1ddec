"""Forecasts of many series against a plain single-series restatement of the rules."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from spendframe.operators import forecast as fc

Z = {"80": 1.2815515594, "95": 1.9599639845}


def add_months(first, n):
    index = first.year * 12 + first.month - 1 + n
    return dt.date(index // 12, index % 12 + 1, 1)


def model(name, y, steps):
    """(points, residuals)."""
    n = len(y)
    if name == "ensemble":
        w = {}
        for m in ("linear", "seasonal_naive"):
            wape = accuracy(m, y)[0]
            w[m] = 1 / wape if wape else 0.0
        lin, sn = model("linear", y, steps), model("seasonal_naive", y, steps)
        a, b = (2 * w["linear"], w["seasonal_naive"]) if any(w.values()) else (2.0, 1.0)
        return (a * lin[0] + b * sn[0]) / (a + b), np.concatenate([lin[1], lin[1], sn[1]])
    if name == "linear":
        slope, level = np.polyfit(range(n), y, 1) if n > 1 else (0.0, y[0])
        return slope * np.arange(n, n + steps) + level, y - (slope * np.arange(n) + level)
    if name == "seasonal_naive" and n >= 12:
        return np.array([y[n - 12 + i % 12] for i in range(steps)]), y[12:] - y[:-12]
    return np.repeat(y[-1], steps), np.diff(y) if n > 1 else np.zeros(1)


def accuracy(name, y):
    n, a, p, used = len(y), [], [], 0
    for k in (3, 2, 1):
        cut = n - 3 * k
        if n >= 7 and cut >= 4:
            a += list(y[cut:cut + 3])
            p += list(model(name, y[:cut], 3)[0])
            used += 1
    a, p = np.array(a), np.array(p)
    if not used or not np.abs(a).sum():
        return None, used
    return float(np.abs(a - p).sum() / np.abs(a).sum() * 100), used


def expected(y, horizon):
    scored = []
    for i, (name, run) in enumerate([("seasonal_naive", "seasonal_naive"), ("linear", "linear"), ("holt_winters", "linear"),
                                     ("ensemble", "ensemble")] + ([("sarima", "linear")] if len(y) >= 24 else [])):
        wape, _ = accuracy(run, y)
        if wape is not None:
            scored.append((wape, i, name, run))
    best = min(scored) if scored else (None, 0, "holt_winters", "linear")
    points, resid = model(best[3], y, horizon)
    sigma = float(np.std(resid, ddof=1)) if len(resid) > 1 else 0.0
    rows = []
    for h, v in enumerate(points, 1):
        cost, fan = max(v, 0.0), sigma * math.sqrt(h)
        lo80, hi80 = max(min(v - Z["80"] * fan, cost), 0), max(v + Z["80"] * fan, cost, 0)
        rows.append((cost, lo80, hi80, max(min(v - Z["95"] * fan, lo80), 0), max(v + Z["95"] * fan, hi80, 0)))
    return best[2], best[0], rows


def data():
    rng = random.Random(11)
    out = {f"n{n}": [rng.uniform(50, 150) + 3 * i for i in range(n)] for n in (1, 2, 3, 6, 7, 9, 11, 12, 13, 19, 23, 24, 31)}
    out["zero"] = [0.0] * 24
    out["line"] = [10.0 + 2 * i for i in range(24)]
    out["season"] = [100 + 50 * math.sin(i * math.pi / 6) + rng.random() for i in range(36)]
    out["falling"] = [100.0 - 4 * i + rng.random() for i in range(24)]
    return out


def frame(spark):
    rows = [(k, add_months(dt.date(2021, 1, 1), i), float(v)) for k, vs in data().items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, period date, cost double")


def test_auto_forecast_matches_brute_force(spark):
    got, summary = {}, {r["k"]: r for r in fc.forecast_summary(frame(spark), ["k"]).collect()}
    for r in fc.forecast_spend(frame(spark), ["k"], 15).orderBy("k", "period").collect():
        got.setdefault(r["k"], []).append(r)
    for k, vs in data().items():
        method, wape, rows = expected(np.array(vs, float), 15)
        # A perfect line scores about 1e-14 either way, so its winner is a matter of rounding.
        if k != "line":
            assert summary[k]["method"] == method, k
        assert summary[k]["wape"] == (None if wape is None else pytest.approx(wape, abs=1e-9)), k
        assert summary[k]["maturity"] == "Unknown" or wape is not None
        assert [r["period"] for r in got[k]] == [add_months(dt.date(2021, 1, 1), len(vs) + i) for i in range(15)]
        for r, want in zip(got[k], rows, strict=True):
            mine = (r["cost"], r["lo80"], r["hi80"], r["lo95"], r["hi95"])
            shown = 1 if k == "line" else 5
            assert mine[:shown] == pytest.approx(want[:shown], rel=1e-7, abs=1e-7), k
            assert 0 <= r["lo95"] <= r["lo80"] <= r["cost"] <= r["hi80"] <= r["hi95"]


@pytest.mark.parametrize("method", ["naive", "seasonal_naive", "linear", "ensemble"])
def test_backtest_matches_brute_force(spark, method):
    got = {r["k"]: r for r in fc.backtest(frame(spark), ["k"], [method]).collect()}
    for k, vs in data().items():
        wape, folds = accuracy(method, np.array(vs, float))
        assert got[k]["folds"] == folds
        if (k, method) == ("line", "ensemble"):
            # An exact fit scores 0, and a component scoring exactly 0 has no weight.
            assert got[k]["wape"] == pytest.approx(accuracy("seasonal_naive", np.array(vs))[0])
            continue
        assert got[k]["wape"] == (None if wape is None else pytest.approx(wape, abs=1e-9)), k


def test_prepare_sums_months_and_tolerates_text(spark):
    df = spark.createDataFrame([("2024-01-09", "2"), ("2024-01-20", "3"), ("2024-03-01", "x")], "period string, cost string")
    assert [(r[0].month, r[1]) for r in fc.prepare(df).orderBy("period").collect()] == [(1, 5.0), (3, 0.0)]


def test_unknown_method_and_estate_series(spark, one):
    df = frame(spark).filter("k = 'n24'").drop("k")
    out = one(fc.forecast_summary(df, [], "magic"))
    assert out["method"] in fc.CANDIDATES and any("magic" in n for n in out["notes"])
    assert fc.forecast_spend(df.filter("cost < 0"), [], 3).count() == 0


def months(spark, n, cost=100.0, start=dt.date(2024, 1, 1)):
    return spark.createDataFrame([(add_months(start, i), cost) for i in range(n)], "period date, cost double")


def test_cliffs_stack_per_purchase(spark, charges):
    bought = dict(ChargeCategory="Purchase", CommitmentDiscountId="c", day="2023-03-15")
    used = dict(CommitmentDiscountId="c", CommitmentDiscountStatus="Used", ListCost=30.0, EffectiveCost=20.0)
    df = charges(bought, bought, dict(bought, day="2022-01-01"), dict(bought, ProviderName="GCP"), used, dict(used, day="2024-02-01"))
    out = [(r["cost_with_cliffs"], r["cliff"]) for r in fc.commitment_expiry_overlay(df, months(spark, 4)).orderBy("period").collect()]
    assert out == [(100.0, False), (100.0, False), (120.0, True), (120.0, False)]
    once = fc.commitment_expiry_overlay(df, months(spark, 4), per="provider").orderBy("period").collect()
    assert [r["cost_with_cliffs"] for r in once] == [100.0, 100.0, 110.0, 110.0]
    summary = fc.cliff_summary(fc.commitment_expiry_overlay(df, months(spark, 4))).first()
    assert (summary["cliff_months"], summary["extra_usd"]) == (["2024-03"], 40.0)


def test_no_purchases_changes_nothing(spark, charges):
    out = fc.commitment_expiry_overlay(charges(dict()), months(spark, 2)).collect()
    assert [(r["cost_with_cliffs"], r["cliff"]) for r in out] == [(100.0, False)] * 2


def test_drivers_compound_and_bad_ones_are_skipped(spark):
    entries = [{"period": "2024-02", "pct": 0.1}, {"pct": 1}, {"period": "2024-13", "pct": 1}, {"period": "2024-02", "pct": "x"},
               {"period": "2024-03", "pct": 0.5, "label": "plant"}]
    out = fc.driver_overlay(months(spark, 3), entries).orderBy("period").collect()
    assert [r["cost_adjusted"] for r in out] == pytest.approx([100.0, 110.0, 165.0])
    assert [r["applied_drivers"] for r in out] == [[], ["+10% from 2024-02"], ["+10% from 2024-02", "plant"]]
