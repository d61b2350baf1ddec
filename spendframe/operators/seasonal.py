"""Seasonal forecasts of many monthly series, as array expressions on one row per series.

`holt_winters` smooths level, damped trend and twelve seasons, multiplicative where all values are positive and additive
elsewhere; its parameters minimise the squared one-step errors over a fixed grid and then over a finer one around the best
point. `arima` is a (1,1,1)(0,1,1) model of twelve months estimated by two regressions (Hannan-Rissanen): a long autoregression of the
doubly differenced series gives the shocks, and a second regression takes the last value and the shocks of one
month and one year ago. Both need two years and take the linear trend below that, as `computed_as` says.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from spendframe.operators.forecast import _fit, _sigma, _sum, future_periods, prepare, repair_bands, with_interval

SEASON = 12
#: Smoothing of level, trend and season, and damping: every combination is tried, then the finer steps around the best.
GRID = list(product((0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.2, 0.4), (0.05, 0.2, 0.4), (0.9, 0.98)))
FINER = list(product((-0.1, 0.0, 0.1), (-0.04, 0.0, 0.04), (-0.04, 0.0, 0.04)))
LEAST, MOST = 0.01, 0.99
#: Lags of the long autoregression.
LAGS = 3


def _rows(history: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: y, n, last month, and the linear trend with its residual spread."""
    months = F.array_sort(F.collect_list(F.struct("period", "cost")))
    rows = prepare(history, keys).groupBy(*keys).agg(months.alias("hist"))
    rows = rows.filter(F.size("hist") > 0).withColumn("y", F.transform("hist", lambda h: h["cost"])).withColumn("n", F.size("hist"))
    rows = rows.withColumn("last", F.element_at("hist", -1)["period"]).drop("hist").withColumn("fit", _fit(F.col("y"), F.col("n")))
    off = F.transform("y", lambda v, i: v - (F.col("fit")["slope"] * i + F.col("fit")["level"]))
    return rows.withColumn("line_sigma", _sigma(off))


def _smoothed(p: Column) -> Column:
    """The state after all of `y` under the parameters `p`, with the sums of errors and of their squares; null where undefined."""
    y, m = F.col("y"), F.lit(SEASON)
    mul, first, second = F.col("_mul"), F.col("_first"), F.col("_second")
    start = F.struct(first.alias("level"), ((second - first) / m).alias("trend"),
                     F.transform(F.slice(y, 1, SEASON), lambda v: F.when(mul, F.try_divide(v, first)).otherwise(v - first)).alias("season"),
                     F.lit(0.0).alias("sse"), F.lit(0.0).alias("sum"))

    def step(a: Column, v: Column) -> Column:
        s, base = F.element_at(a["season"], 1), a["level"] + p["phi"] * a["trend"]
        e = v - F.when(mul, base * s).otherwise(base + s)
        level = p["alpha"] * F.when(mul, F.try_divide(v, s)).otherwise(v - s) + (1 - p["alpha"]) * base
        season = p["gamma"] * F.when(mul, F.try_divide(v, level)).otherwise(v - level) + (1 - p["gamma"]) * s
        return F.struct(level.alias("level"), (p["beta"] * (level - a["level"]) + (1 - p["beta"]) * p["phi"] * a["trend"]).alias("trend"),
                        F.concat(F.slice(a["season"], 2, SEASON - 1), F.array(season)).alias("season"),
                        (a["sse"] + e * e).alias("sse"), (a["sum"] + e).alias("sum"))

    return F.aggregate(y, start, step, lambda a: F.struct(
        a["sse"], p["i"], p["alpha"], p["beta"], p["gamma"], p["phi"], a["level"], a["trend"], a["season"], a["sum"]))


def _best(parameters: Column) -> Column:
    return F.array_min(F.filter(F.transform(parameters, _smoothed), lambda c: c["sse"].isNotNull()))


def holt_winters(history: DataFrame, keys: list[str] = [], horizon: int = 24) -> DataFrame:
    """(keys, computed_as, alpha, beta, gamma, phi, period, step, sigma, yhat): raw points of seasonal smoothing.

    Ties between parameters go to the first ones tried. Null costs count 0, duplicate months add up, as in `forecast.prepare`.
    """
    rows = _rows(history, keys)
    part = lambda a: _sum(F.slice("y", a, SEASON)) / SEASON
    rows = rows.withColumns({"_first": part(1), "_second": part(SEASON + 1), "_mul": F.forall("y", lambda v: v > 0)})
    enough = F.col("n") >= 2 * SEASON
    grid = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(k) for k, v in zip(("alpha", "beta", "gamma", "phi"), p)])
                     for i, p in enumerate(GRID)])
    rows = rows.withColumn("_coarse", F.when(enough, _best(grid)))
    moves = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(k) for k, v in zip("abg", d)]) for i, d in enumerate(FINER)])
    held = lambda v: F.least(F.greatest(v, F.lit(LEAST)), F.lit(MOST))
    c = F.col("_coarse")
    finer = F.transform(moves, lambda o: F.struct(o["i"], held(c["alpha"] + o["a"]).alias("alpha"), held(c["beta"] + o["b"]).alias("beta"),
                                                  held(c["gamma"] + o["g"]).alias("gamma"), c["phi"].alias("phi")))
    rows = rows.withColumn("_best", F.when(c.isNotNull(), _best(finer)))
    b = F.col("_best")
    spread = F.sqrt(F.greatest(b["sse"] - b["sum"] * b["sum"] / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))

    def point(step: Column) -> Column:
        damped = b["phi"] * (1 - F.pow(b["phi"], step + 1)) / (1 - b["phi"])
        base, s = b["level"] + damped * b["trend"], F.get(b["season"], (step % SEASON).cast("int"))
        return F.when(F.col("_mul"), base * s).otherwise(base + s)

    kind = F.when(b.isNull(), "linear").when(F.col("_mul"), "holt_winters_multiplicative").otherwise("holt_winters_additive")
    return _points(rows, keys, horizon, kind, [b[k].alias(k) for k in ("alpha", "beta", "gamma", "phi")], b.isNotNull(), spread, point)


def _points(rows: DataFrame, keys: list[str], horizon: int, kind: Column, extra: list[Column], own: Column, spread: Column, point) -> DataFrame:
    """The future months; the linear trend where the model is not `own`."""
    step = F.col("step")
    line = F.col("fit")["slope"] * (F.col("n") + step) + F.col("fit")["level"]
    made = rows.withColumn("computed_as", kind).withColumn("sigma", F.when(own, spread).otherwise(F.col("line_sigma")))
    made = made.select("*", F.posexplode(future_periods(F.col("last"), horizon)).alias("step", "period"))
    return made.select(*keys, "computed_as", *extra, "period", (step + 1).alias("step"), "sigma", F.when(own, point(step)).otherwise(line).alias("yhat"))


def _solved(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Three linear equations by determinants; null where they have no single solution."""
    def determinant(m):
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    whole = determinant(a)
    return [F.try_divide(determinant([[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]), whole) for k in range(3)]


def _regressed(target: str, columns: list[str]) -> Column:
    """Coefficients of `target` on three columns, arrays of one length, by the normal equations."""
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p * q))
    sums = [[dot(x, y) for y in columns] for x in columns]
    return F.array(*_solved(sums, [dot(x, target) for x in columns]))


def arima(history: DataFrame, keys: list[str] = [], horizon: int = 24) -> DataFrame:
    """(keys, computed_as, ar, ma, seasonal_ma, period, step, sigma, yhat): raw points of the seasonal ARIMA model.

    Where a regression has no single solution (a constant series, say) its coefficients are 0, and the points repeat last year's
    steps from month to month. Shocks after the history are 0. Three years and four months are needed for all regressions; below that the
    coefficients are 0 as well.
    """
    rows = _rows(history, keys)
    y, n = F.col("y"), F.col("n")
    at = lambda i: F.get("y", i)
    enough, season = n >= 2 * SEASON, SEASON
    rows = rows.withColumn("_w", F.when(enough, F.transform(F.sequence(F.lit(season + 1), n - 1), lambda i: (
        (at(i) - at(i - 1)) - (at(i - season) - at(i - season - 1))))))
    rows = rows.withColumn("_k", F.coalesce(F.size("_w"), F.lit(0)))
    lagged = lambda array, first, lag, size: F.slice(array, F.lit(first - lag + 1), F.greatest(size, F.lit(0)))
    # The long autoregression: w from its LAGS-th value on, and its shocks; the values before have none.
    size = F.col("_k") - LAGS
    rows = rows.withColumns({"_t0": lagged("_w", LAGS, 0, size), **{f"_t{j}": lagged("_w", LAGS, j, size) for j in range(1, LAGS + 1)}})
    rows = rows.withColumn("_long", _filled(_regressed("_t0", ["_t1", "_t2", "_t3"])))
    shocks = F.transform(F.arrays_zip("_t0", "_t1", "_t2", "_t3"), lambda z: z["_t0"] - (
        F.get("_long", F.lit(0)) * z["_t1"] + F.get("_long", F.lit(1)) * z["_t2"] + F.get("_long", F.lit(2)) * z["_t3"]))
    rows = rows.withColumn("_e", F.concat(F.array_repeat(F.lit(0.0), LAGS), shocks))
    first = LAGS + season
    size = F.col("_k") - first
    rows = rows.withColumns({"_u0": lagged("_w", first, 0, size), "_u1": lagged("_w", first, 1, size), "_u2": lagged("_e", first, 1, size),
                             "_u3": lagged("_e", first, season, size)})
    rows = rows.withColumn("_c", _filled(_regressed("_u0", ["_u1", "_u2", "_u3"])))
    c = [F.get("_c", F.lit(i)) for i in range(3)]
    rows = rows.withColumn("_residuals", F.transform(F.arrays_zip("_u0", "_u1", "_u2", "_u3"), lambda z: z["_u0"] - (
        c[0] * z["_u1"] + c[1] * z["_u2"] + c[2] * z["_u3"])))

    def ahead(a: Column, h: Column) -> Column:
        """The values and differences with one more month at their end."""
        gap, length = F.size(a["w"]), F.size(a["y"])
        w = c[0] * F.element_at(a["w"], -1) + c[1] * F.coalesce(F.get("_e", gap - 1), F.lit(0.0)) + c[2] * F.coalesce(F.get("_e", gap - season), F.lit(0.0))
        value = w + F.element_at(a["y"], -1) + F.get(a["y"], length - season) - F.get(a["y"], length - season - 1)
        return F.struct(F.concat(a["y"], F.array(value)).alias("y"), F.concat(a["w"], F.array(w)).alias("w"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.struct(y.alias("y"), F.col("_w").alias("w")), ahead, lambda a: F.slice(a["y"], n + 1, horizon))
    rows = rows.withColumn("_path", F.when(enough, path))
    spread = F.when(F.size("_residuals") > 1, _sigma(F.col("_residuals"))).otherwise(_sigma(F.col("_w")))
    kind = F.when(enough, "arima").otherwise("linear")
    return _points(rows, keys, horizon, kind, [F.when(enough, v).alias(k) for k, v in zip(("ar", "ma", "seasonal_ma"), c)],
                   enough, spread, lambda step: F.get("_path", step))


def _filled(coefficients: Column) -> Column:
    """The coefficients, or zeros if one is undefined or no stationary model has it."""
    sound = F.forall(coefficients, lambda v: v.isNotNull() & (F.abs(v) < 1))
    return F.when(F.coalesce(sound, F.lit(False)), coefficients).otherwise(F.array(*[F.lit(0.0)] * 3))


def forecast(history: DataFrame, keys: list[str] = [], horizon: int = 24, method: str = "holt_winters") -> DataFrame:
    """(keys, computed_as, period, cost, lo80, hi80, lo95, hi95) of `holt_winters` or `arima`, bands repaired."""
    points = {"holt_winters": holt_winters, "arima": arima}[method](history, keys, horizon)
    return repair_bands(with_interval(points)).select(*keys, "computed_as", "period", "cost", "lo80", "hi80", "lo95", "hi95")
