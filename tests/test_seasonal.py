"""Seasonal models against a plain single-series restatement, and on series with a season they must catch."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest

from spendframe.operators import anomaly as an, forecast as fc, seasonal as sn


def month(i):
    return dt.date(2015 + i // 12, i % 12 + 1, 1)


def history(spark, **series):
    rows = [(k, month(i), float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, period date, cost double")


def points(df, key):
    return [(r.computed_as, r.yhat, r.sigma) for r in sorted((r for r in df.collect() if r.k == key), key=lambda r: r.step)]


def smoothed(y, alpha, beta, gamma, phi, horizon):
    """(squared error, residuals, points) of one parameter choice, or None."""
    mul = min(y) > 0
    first, second = sum(y[:12]) / 12, sum(y[12:24]) / 12
    level, trend, season, errors = first, (second - first) / 12, [v / first if mul else v - first for v in y[:12]], []
    for v in y:
        s, base = season.pop(0), level + phi * trend
        if mul and s == 0:
            return None
        errors.append(v - (base * s if mul else base + s))
        new = alpha * (v / s if mul else v - s) + (1 - alpha) * base
        if mul and new == 0:
            return None
        season.append(gamma * (v / new if mul else v - new) + (1 - gamma) * s)
        level, trend = new, beta * (new - level) + (1 - beta) * phi * trend
    out = []
    for h in range(1, horizon + 1):
        base = level + sum(phi**i for i in range(1, h + 1)) * trend
        out.append(base * season[(h - 1) % 12] if mul else base + season[(h - 1) % 12])
    return sum(e * e for e in errors), errors, out


def brute_holt_winters(y, horizon):
    tried = [(p, smoothed(y, *p, horizon)) for p in sn.GRID]
    (a, b, g, phi), _ = min((t for t in tried if t[1]), key=lambda t: t[1][0])
    hold = lambda v: min(max(v, 0.01), 0.99)
    finer = [smoothed(y, hold(a + i), hold(b + j), hold(g + k), phi, horizon)
             for i, j, k in itertools.product((-0.1, 0.0, 0.1), (-0.04, 0.0, 0.04), (-0.04, 0.0, 0.04))]
    return min((t for t in finer if t), key=lambda t: t[0])


def brute_arima(y, horizon):
    w = [(y[i] - y[i - 1]) - (y[i - 12] - y[i - 13]) for i in range(13, len(y))]

    def regression(target, columns):
        a = np.array(columns).T
        if not len(target) or np.linalg.matrix_rank(a.T @ a) < 3:
            return np.zeros(3)
        c = np.linalg.solve(a.T @ a, a.T @ np.array(target))
        return c if (np.abs(c) < 1).all() else np.zeros(3)

    long = regression(w[3:], [w[2:-1], w[1:-2], w[:-3]])
    e = [0.0] * 3 + [w[t] - sum(c * w[t - j] for c, j in zip(long, (1, 2, 3))) for t in range(3, len(w))]
    at = range(15, len(w))
    c = regression([w[t] for t in at], [[w[t - 1] for t in at], [e[t - 1] for t in at], [e[t - 12] for t in at]])
    y, k = list(y), len(w)
    shock = lambda t: e[t] if 0 <= t < k else 0.0
    for h in range(horizon):
        w.append(c[0] * w[-1] + c[1] * shock(k + h - 1) + c[2] * shock(k + h - 12))
        y.append(w[-1] + y[-1] + y[-12] - y[-13])
    return c, y[-horizon:]


def seasonal_series(n, seed, noise=0.02):
    rng = random.Random(seed)
    return [(1000 + 12 * i) * (1 + 0.35 * math.sin(2 * math.pi * i / 12)) * (1 + rng.gauss(0, noise)) for i in range(n)]


def test_holt_winters_against_brute_force(spark):
    rng = random.Random(5)
    data = {"mul": seasonal_series(50, 1), "add": [v - 900 for v in seasonal_series(37, 2)], "wild": [rng.uniform(1, 9) for _ in range(24)],
            "zeros": [0.0, 5.0] * 15}
    found = sn.holt_winters(history(spark, **data), ["k"], 15)
    for key, y in data.items():
        sse, errors, expected = brute_holt_winters(y, 15)
        got = points(found, key)
        assert [p[1] for p in got] == pytest.approx(expected, rel=1e-6, abs=1e-6)
        assert got[0][2] == pytest.approx(float(np.std(errors, ddof=1)), rel=1e-6)
        assert {p[0] for p in got} == {"holt_winters_multiplicative" if min(y) > 0 else "holt_winters_additive"}


def test_arima_against_brute_force(spark):
    rng = random.Random(6)
    data = {"long": seasonal_series(70, 3), "noise": [rng.uniform(1, 9) for _ in range(48)], "short": seasonal_series(26, 4), "flat": [7.0] * 40}
    found = sn.arima(history(spark, **data), ["k"], 15)
    rows = {r.k: r for r in found.collect()}
    for key, y in data.items():
        c, expected = brute_arima(y, 15)
        assert [p[1] for p in points(found, key)] == pytest.approx(expected, rel=1e-6)
        assert [rows[key].ar, rows[key].ma, rows[key].seasonal_ma] == pytest.approx(list(c), abs=1e-6)
    assert any(rows["noise"][n] for n in ("ar", "ma", "seasonal_ma"))


@pytest.mark.parametrize("model", [sn.holt_winters, sn.arima])
def test_a_season_is_forecast_better_than_by_last_year_or_a_line(spark, model):
    data = {f"s{i}": seasonal_series(60, 20 + i) for i in range(6)}
    train = history(spark, **{k: v[:48] for k, v in data.items()})

    def wape(df):
        found = {(r.k, r.period): r.yhat for r in df.collect()}
        return sum(abs(found[k, month(48 + i)] - v) for k, vs in data.items() for i, v in enumerate(vs[48:])) / sum(sum(vs[48:]) for vs in data.values())

    own = wape(model(train, ["k"], 12))
    assert own < wape(fc.forecast_points(train, ["k"], 12, "seasonal_naive"))
    assert own < 0.5 * wape(fc.forecast_points(train, ["k"], 12, "linear"))


def test_short_and_odd_histories(spark):
    data = {"one": [4.0], "year": seasonal_series(23, 9), "flat": [7.0] * 30, "none": [0.0] * 30}
    df = history(spark, **data)
    line = {(r.k, r.period): r.yhat for r in fc.forecast_points(df, ["k"], 5, "linear").collect()}
    for model in (sn.holt_winters, sn.arima):
        for r in model(df, ["k"], 5).collect():
            if r.k in ("one", "year"):
                assert r.computed_as == "linear" and r.yhat == pytest.approx(line[r.k, r.period])
            else:
                assert r.yhat == pytest.approx(7.0 if r.k == "flat" else 0.0) and r.sigma == pytest.approx(0.0)
    assert sn.holt_winters(df.limit(0), ["k"], 5).count() == 0 and sn.arima(df.limit(0), ["k"], 5).count() == 0
    assert len(sn.holt_winters(df.filter("k = 'flat'").drop("k"), [], 5).collect()) == 5
    for method in ("holt_winters", "arima"):
        for r in sn.forecast(df, ["k"], 5, method).collect():
            assert 0 <= r.lo95 <= r.lo80 <= r.cost <= r.hi80 <= r.hi95


def weekly(n, seed, spike=None):
    rng = random.Random(seed)
    out = [(100 + 0.1 * i) * (0.3 if i % 7 in (5, 6) else 1.0) * (1 + rng.gauss(0, 0.02)) for i in range(n)]
    if spike is not None:
        out[spike] *= 3
    return out


def daily(spark, **series):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, period date, cost double")


def test_a_weekly_season_is_no_anomaly(spark):
    df = daily(spark, calm=weekly(120, 1), spiked=weekly(120, 2, 60), new=weekly(13, 3), flat=[5.0] * 40, single=[3.0])
    found = {(r.k, r.period): r for r in an.detect(df, ["k"], "stl").collect()}
    assert len(found) == 120 + 120 + 13 + 40 + 1
    hit = [k for k, r in found.items() if r.is_anomaly and k[0] != "new"]
    assert hit == [("spiked", dt.date(2024, 1, 1) + dt.timedelta(days=60))]
    assert sum(r.is_anomaly for r in an.detect(df.filter("k = 'calm'"), ["k"]).collect()) > 0  # the median takes weekends for drops
    assert all(abs(found["flat", dt.date(2024, 1, 1) + dt.timedelta(days=i)].residual) < 1e-9 for i in range(40))


def test_the_decomposition_finds_its_parts(spark):
    season = [3.0, 1.0, -2.0, -1.0, 4.0, -4.0, -1.0]
    df = daily(spark, k=[50 + 0.5 * i + season[i % 7] for i in range(140)])
    rows = sorted(an.decompose(df, ["k"]).collect(), key=lambda r: r.period)
    for i, r in enumerate(rows[35:-35], 35):
        assert r.seasonal == pytest.approx(season[i % 7], abs=0.05) and r.trend == pytest.approx(50 + 0.5 * i, abs=0.05)
    assert an.decompose(df.limit(0), ["k"]).count() == 0


def test_all_passes_share_one_shuffle_and_sort(spark):
    plan = an.decompose(daily(spark, k=weekly(30, 1)), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
