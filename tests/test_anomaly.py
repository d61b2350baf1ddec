import datetime as dt
import random
import statistics as st

import pytest

from spendframe.operators import anomaly as an


def series(spark, **values):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), k, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "period date, k string, cost double")


def brute(costs, method):
    """The stated rules, one series at a time."""
    n = len(costs)
    if n < 10:
        return [(c, 0.0, 0.0, False) for c in costs]
    if method == "stl_mad":
        expected = [st.median(costs[max(0, i - 3):i + 4]) for i in range(n)]
    else:
        expected = [(st.median if method == "mad" else st.mean)(costs)] * n
    residual = [c - e for c, e in zip(costs, expected)]
    spread = st.stdev(residual) or 1.0
    if method == "zscore":
        score = [r / spread for r in residual]
    else:
        center = st.median(residual)
        mad = st.median([abs(r - center) for r in residual])
        score = [0.6745 * r / (mad if mad > 0 else spread) for r in residual]
    dev = [r / e * 100 if abs(e) > 1e-9 else 0.0 for r, e in zip(residual, expected)]
    return [(e, s, d, abs(s) > 3.5 and abs(d) >= 25) for e, s, d in zip(expected, score, dev)]


@pytest.mark.parametrize("method", ["stl_mad", "mad", "zscore"])
def test_matches_brute_force(spark, method):
    rng = random.Random(3)
    data = {f"s{n}": [rng.choice([50, 100, 100, 100, 130, 400]) for _ in range(n)] for n in (3, 9, 10, 11, 40)}
    data |= {"flat": [5] * 20, "zero": [0] * 12, "spike": [10] * 15 + [100] + [10] * 15}
    out = an.detect(series(spark, **data), ["k"], method).orderBy("k", "period").collect()
    for k, costs in data.items():
        got = [(r["expected"], r["score"], r["deviation_pct"], r["is_anomaly"]) for r in out if r["k"] == k]
        for mine, theirs in zip(got, brute([float(c) for c in costs], method), strict=True):
            assert mine == pytest.approx(theirs)


def test_spike_on_a_flat_series(spark):
    # MAD is 0, so the deviation of the residual takes over.
    flagged = an.detect(series(spark, a=[10] * 15 + [100] + [10] * 15), ["k"], "mad").filter("is_anomaly").collect()
    assert [(r["cost"], r["severity"]) for r in flagged] == [(100.0, "critical")]


def test_threshold_is_monotone_and_flags_are_never_good(spark):
    rng = random.Random(5)
    df = series(spark, a=[rng.gauss(100, 30) for _ in range(60)])
    counts = [an.detect(df, ["k"], threshold=t).filter("is_anomaly").count() for t in (1.0, 2.0, 3.5)]
    assert counts == sorted(counts, reverse=True)
    assert an.detect(df, ["k"], threshold=1.0, min_deviation_pct=25.1).filter("is_anomaly and severity = 'good'").count() == 0


def test_by_dimension_and_report(charges):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    rows = [dict(day=str(d), ServiceCategory=c, EffectiveCost=c == "Compute" and i == 20 and 900.0 or 100.0 + i % 3)
            for i, d in enumerate(days) for c in ("Compute", "Storage")]
    flagged = an.detect_by_dimension(charges(*rows))
    got = flagged.collect()
    assert [(r["ServiceCategory"], r["period"], r["severity"], r["method"]) for r in got] == [
        ("Compute", days[20], "critical", "rolling_median_mad (stl unavailable)")]
    assert an.report(flagged, "ServiceCategory", top=5).count() == 1
    assert an.summarise(flagged, "ServiceCategory").first()["deviation_abs"] == pytest.approx(got[0]["residual"])
