"""Anomaly detection over many daily series at once.

A series is a value of the dimension; every statistic is a window partitioned by it, so one
shuffle of the daily report serves all series. A window never holds more than one series'
days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendframe.functions.columns import severity
from spendframe.operators.rollups import daily_grain

# --- fixed values: modified z-score scale, threshold, warm-up, materiality ----------------
MAD_SCALE = 0.6745
THRESHOLD = 3.5
MIN_HISTORY = 10
MIN_DEVIATION_PCT = 25.0
METHOD_LABEL = {"stl_mad": "rolling_median_mad (stl unavailable)", "stl": "stl_mad", "mad": "mad", "zscore": "zscore"}

#: Seasonal-trend decomposition: days of a season, half widths of the local fits (of the season in seasons, of the low-pass
#: and the trend in days), passes before the first and after each weighting, weightings.
PERIOD, SEASON_HALF, LOW_HALF, TREND_HALF = 7, 3, 4, 7
PASSES, WEIGHTINGS = 2, 2


def _parts(keys: list[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def _around(column: str, offset: int, ordered) -> Column:
    return F.lag(column, -offset).over(ordered)


def _loess(df: DataFrame, value: str, weight: str | None, half: int, step: int, ordered, out: str) -> DataFrame:
    """`out`: a weighted line through the rows up to `half` steps away, at the row itself.

    Weights are tricube in the distance, times `weight`. Rows beyond the ends of the series don't count; where no
    line is determined, the weighted mean stands, and the value itself where nothing has weight.
    """
    offsets = [d * step for d in range(-half, half + 1)]
    tricube = {d: (1 - (abs(d) / ((half + 1) * step)) ** 3) ** 3 for d in offsets}
    names = {d: (f"_y{i}", f"_w{i}") for i, d in enumerate(offsets)}
    near = {names[d][0]: _around(value, d, ordered) for d in offsets}
    near |= {names[d][1]: _around(weight, d, ordered) for d in offsets} if weight else {}
    df = df.withColumns(near)
    zero = F.lit(0.0)
    share = {d: F.when(F.col(names[d][0]).isNull(), zero).otherwise(tricube[d] * F.col(names[d][1]) if weight else F.lit(tricube[d])) for d in offsets}
    df = df.withColumns({f"_k{i}": share[d] for i, d in enumerate(offsets)})
    sums = {"_s0": zero, "_s1": zero, "_s2": zero, "_t0": zero, "_t1": zero}
    for i, d in enumerate(offsets):
        k, y = F.col(f"_k{i}"), F.coalesce(names[d][0], zero)
        terms = {"_s0": k, "_s1": k * float(d), "_s2": k * float(d * d), "_t0": k * y, "_t1": k * float(d) * y}
        sums = {name: total + terms[name] for name, total in sums.items()}
    df = df.withColumns(sums)
    spread = F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1")
    line = (F.col("_s2") * F.col("_t0") - F.col("_s1") * F.col("_t1")) / spread
    fit = F.when(spread > 1e-9, line).when(F.col("_s0") > 1e-9, F.col("_t0") / F.col("_s0")).otherwise(F.col(value))
    return df.withColumn(out, fit).drop(*near, *[f"_k{i}" for i in range(len(offsets))], *sums)


def _moving(df: DataFrame, value: str, half: int, ordered, out: str) -> DataFrame:
    """`out`: the mean of the rows up to `half` away; null where one of them is missing."""
    total = F.lit(0.0)
    for d in range(-half, half + 1):
        total = total + _around(value, d, ordered)
    return df.withColumn(out, total / (2 * half + 1))


def decompose(series: DataFrame, keys: list[str], period: int = PERIOD) -> DataFrame:
    """`series` with `seasonal` and `trend` of `cost`, by local regressions over the rows of each series in order.

    A pass fits each day of the season over its neighbouring seasons, takes off what moves slowly in that fit (moving means and a
    local fit; at the ends the nearest one), and fits the trend to the rest. After PASSES passes the rows are weighted by how well they
    fit (bisquare of the residual in six medians), WEIGHTINGS times with one more pass each, so that single spikes bend neither.
    All windows have one partitioning and one order: one shuffle and one sort, whatever the number of passes.
    """
    ordered = _parts(keys).orderBy("period")
    before = _parts(keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    after = _parts(keys).orderBy("period").rowsBetween(0, Window.unboundedFollowing)
    df = series.withColumn("trend", F.lit(0.0))
    weight = None
    for number in range(PASSES + WEIGHTINGS):
        if number >= PASSES:
            df = df.withColumn("_off", F.abs(F.col("cost") - F.col("seasonal") - F.col("trend")))
            df = df.withColumn("_scale", 6 * F.median("_off").over(_parts(keys)))
            u = F.col("_off") / F.col("_scale")
            df = df.withColumn("_weight", F.when(F.col("_scale") <= 1e-12, 1.0).when(u < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)).drop("_off", "_scale")
            weight = "_weight"
        df = df.withColumn("_detrended", F.col("cost") - F.col("trend"))
        df = _loess(df, "_detrended", weight, SEASON_HALF, period, ordered, "_cycle")
        for name, source, half in (("_m1", "_cycle", period // 2), ("_m2", "_m1", period // 2), ("_m3", "_m2", 1)):
            df = _moving(df, source, half, ordered, name)
        df = df.withColumn("_m3", F.coalesce("_m3", F.last("_m3", True).over(before), F.first("_m3", True).over(after), F.lit(0.0)))
        df = _loess(df, "_m3", None, LOW_HALF, 1, ordered, "_low")
        df = df.withColumn("seasonal", F.col("_cycle") - F.col("_low")).withColumn("_rest", F.col("cost") - F.col("seasonal"))
        df = _loess(df, "_rest", weight, TREND_HALF, 1, ordered, "trend")
        df = df.drop("_detrended", "_cycle", "_m1", "_m2", "_m3", "_low", "_rest")
    return df.drop("_weight")


def with_expected(series: DataFrame, keys: list[str], method: str = "stl_mad") -> DataFrame:
    """Expected value per point.

    `stl_mad` needs a decomposition library; without one its stated substitute applies: the
    median of the seven rows centred on the point. `stl` is the decomposition itself (`decompose`) for series of two
    seasons or more, and that median below. `mad` takes the series median, `zscore` its mean.
    """
    whole = _parts(keys)
    if method == "stl":
        series = decompose(series, keys)
        near = F.percentile("cost", 0.5).over(whole.orderBy("period").rowsBetween(-3, 3))
        own = F.col("seasonal") + F.col("trend")
        expected = F.when(F.count(F.lit(1)).over(whole) >= 2 * PERIOD, own).otherwise(near)
    elif method == "stl_mad":
        near = whole.orderBy("period").rowsBetween(-3, 3)
        expected = F.percentile("cost", 0.5).over(near)
    elif method == "zscore":
        expected = F.avg("cost").over(whole)
    else:
        expected = F.median("cost").over(whole)
    n = F.count(F.lit(1)).over(whole)
    warm = F.col("n") < MIN_HISTORY
    return (series.withColumns({"n": n, "e": expected})
            .withColumn("expected", F.when(warm, F.col("cost")).otherwise(F.col("e"))).drop("e", "seasonal", "trend")
            .withColumn("residual", F.col("cost") - F.col("expected")))


def _spread(keys: list[str]) -> Column:
    """Sample standard deviation of the residual, 1 when it is 0."""
    return F.coalesce(F.nullif(F.stddev_samp("residual").over(_parts(keys)), F.lit(0.0)), F.lit(1.0))


def with_score(df: DataFrame, keys: list[str], method: str = "stl_mad") -> DataFrame:
    """Residual over its dispersion: MAD (or the deviation when MAD is 0), else deviation."""
    whole = _parts(keys)
    if method == "zscore":
        scored = df.withColumn("score", F.col("residual") / _spread(keys))
    else:
        off = F.abs(F.col("residual") - F.median("residual").over(whole))
        scored = df.withColumn("_off", off).withColumns(
            {"_mad": F.median("_off").over(whole), "_std": _spread(keys)})
        scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_std"))
        scored = scored.withColumn("score", MAD_SCALE * F.col("residual") / scale).drop("_off", "_mad", "_std")
    deviation = F.when(F.abs("expected") > 1e-9, F.col("residual") / F.col("expected") * 100.0).otherwise(0.0)
    return scored.withColumn("deviation_pct", deviation)


def flag(df: DataFrame, threshold: float = THRESHOLD, min_deviation_pct: float = MIN_DEVIATION_PCT,
         min_cost: float = 0.0) -> DataFrame:
    """Odd *and* material, after warm-up; severity only for flagged points."""
    odd = ((F.col("n") >= MIN_HISTORY) & (F.abs("score") > threshold)
           & (F.abs("deviation_pct") >= min_deviation_pct) & (F.col("cost") >= min_cost))
    return df.withColumn("is_anomaly", odd).withColumn(
        "severity", F.when(F.col("is_anomaly"), severity(F.col("deviation_pct"))).otherwise("good"))


def detect(series: DataFrame, keys: list[str] = [], method: str = "stl_mad", **limits) -> DataFrame:
    """Every point of every series with expected, residual, score, deviation, flag, severity."""
    out = flag(with_score(with_expected(series, keys, method), keys, method), **limits)
    return out.select("period", *keys, "cost", "expected", "residual", "score", "is_anomaly", "severity",
                      "deviation_pct")


def detect_by_dimension(charges: DataFrame, dim: str = "ServiceCategory", method: str = "stl_mad",
                        **limits) -> DataFrame:
    """Flagged points only, each value of `dim` against its own baseline."""
    return (detect(daily_grain(charges, dim), [dim], method, **limits).filter("is_anomaly")
            .withColumn("method", F.lit(METHOD_LABEL[method])))


def summarise(flagged: DataFrame, dim: str) -> DataFrame:
    """Briefing rows; order by `score_abs` descending."""
    return flagged.select(
        "period", F.col(dim).alias("dimension"), F.col("cost").alias("value"), "expected",
        F.col("residual").alias("deviation_abs"), "deviation_pct", "score", "severity",
        F.abs("score").alias("score_abs"))


def report(flagged: DataFrame, dim: str, order: str = "deviation", top: int | None = None) -> DataFrame:
    """Flagged points by deviation (largest first) or by day, optionally the first `top`."""
    first = F.desc("deviation_pct") if order == "deviation" else F.asc("period")
    out = flagged.orderBy(first, "period", dim)
    return out.limit(top) if top else out
