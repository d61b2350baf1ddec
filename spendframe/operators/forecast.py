"""Monthly forecasts for many series at once, with backtests and overlays.

A series is one group of `keys`. Its months are gathered into one row (a calendar bounds their
number), and every model, fold and interval is an array expression on that row. However many
series there are, the only shuffles are the monthly sum and the gathering.

The seasonal smoothing and the ARIMA model of the catalogue need a statistics library; without
one both take their stated substitute, the linear trend. The ensemble then holds that trend
twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendframe.functions.columns import COST, LIST, has_commitment, maturity, month
from spendframe.operators.rollups import monthly

# --- fixed values: interval multipliers, season, fold layout, candidate order --------------
Z80, Z95 = 1.2815515594, 1.9599639845
SEASON = 12
FOLDS, FOLD_MONTHS, MIN_TRAIN = 3, 3, 4
MIN_SARIMA_MONTHS = 24
METHODS = ["naive", "seasonal_naive", "linear", "holt_winters", "sarima", "ensemble"]
CANDIDATES = ["seasonal_naive", "linear", "holt_winters", "ensemble", "sarima"]
#: The model that computes each method here.
COMPUTED_AS = {"holt_winters": "linear", "sarima": "linear"}
#: Ensemble components per model: the linear trend stands in for the smoothing model too.
ENSEMBLE = {"linear": 2.0, "seasonal_naive": 1.0}

_MODELS = ["naive", "seasonal_naive", "linear"]
_ORIGINS = 2 * FOLDS  # fold origins of the series and of its own folds


def prepare(history: DataFrame, keys: list[str] = []) -> DataFrame:
    """Month-aligned history: unusable cost counts 0, duplicate months add up, gaps stay."""
    cost = F.coalesce(F.expr("try_cast(cost AS DOUBLE)"), F.lit(0.0))
    return (history.groupBy(*keys, F.trunc(F.col("period").cast("date"), "month").alias("period"))
            .agg(F.sum(cost).alias("cost")))


def future_periods(last: Column, horizon: int) -> Column:
    """Array of the next `horizon` month starts."""
    return F.sequence(F.add_months(last, 1), F.add_months(last, horizon), F.expr("INTERVAL 1 MONTH"))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def _fit(y: Column, n: Column) -> Column:
    """Least squares over the first `n` values at 0..n-1."""
    zero = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("ty"))
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), zero,
        lambda a, i: F.struct((a["y"] + F.get(y, i)).alias("y"), (a["ty"] + i * F.get(y, i)).alias("ty")),
        lambda a: _line(a, n.cast("double")))


def _line(s: Column, n: Column) -> Column:
    t, tt = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = F.coalesce(F.try_divide(n * s["ty"] - t * s["y"], n * tt - t * t), F.lit(0.0))
    return F.struct(slope.alias("slope"), ((s["y"] - slope * t) / n).alias("level"))


def _predict(model: str, y: Column, n: Column, fit: Column, step: Column) -> Column:
    """Value `step` months (from 0) after the first `n` values."""
    last = _at(y, n - 1)
    if model == "naive":
        return last
    if model == "seasonal_naive":
        return F.when(n < SEASON, last).otherwise(_at(y, n - SEASON + step % SEASON))
    return fit["slope"] * (n + step) + fit["level"]


def _errors(pairs: Column) -> dict[str, Column]:
    """MAPE, WAPE and sMAPE of an array of (a, p) pairs."""
    gap = lambda x: F.abs(x["a"] - x["p"])
    mid = lambda x: (F.abs(x["a"]) + F.abs(x["p"])) / 2.0
    paired = F.filter(pairs, lambda x: x["a"] != 0)
    spread = F.filter(pairs, lambda x: mid(x) != 0)
    return {
        "mape": F.try_divide(_sum(F.transform(paired, lambda x: gap(x) / F.abs(x["a"]))), F.size(paired)) * 100.0,
        "wape": F.try_divide(_sum(F.transform(pairs, gap)), _sum(F.transform(pairs, lambda x: F.abs(x["a"])))) * 100.0,
        "smape": F.try_divide(_sum(F.transform(spread, lambda x: gap(x) / mid(x))), F.size(spread)) * 100.0,
    }


def series(history: DataFrame, keys: list[str] = []) -> DataFrame:
    """One row per series: its values, the trend at every fold origin, fold errors, weights.

    `origins[j]` describes the first n - 3j values: their fit and, for the following three
    months, actuals and predictions. Entries too short to train on are null.
    """
    months = F.array_sort(F.collect_list(F.struct("period", "cost")))
    rows = prepare(history, keys).groupBy(*keys).agg(months.alias("hist")) if keys else \
        prepare(history).agg(months.alias("hist")).filter(F.size("hist") > 0)
    y, n = F.col("y"), F.col("n")
    rows = rows.withColumn("y", F.transform("hist", lambda h: h["cost"])).withColumn("n", F.size("hist"))
    rows = rows.withColumn("last", F.element_at("hist", -1)["period"])
    steps = F.sequence(F.lit(0), F.lit(FOLD_MONTHS - 1))

    def fits(j: Column) -> Column:
        cut = n - FOLD_MONTHS * j
        return F.when((j == 0) | (cut >= MIN_TRAIN), F.struct(cut.alias("cut"), _fit(y, cut).alias("fit")))

    def folds(o: Column) -> Column:
        held_out = F.slice(y, o["cut"] + 1, FOLD_MONTHS)
        predicted = [F.transform(steps, lambda h: _predict(m, y, o["cut"], o["fit"], h)).alias(m) for m in _MODELS]
        return F.when(o.isNotNull(), F.struct(o["cut"], o["fit"], held_out.alias("actual"), *predicted))

    rows = rows.withColumn("trained", F.transform(F.sequence(F.lit(0), F.lit(_ORIGINS)), fits))
    rows = rows.withColumn("origins", F.transform("trained", folds)).drop("trained")

    def weigh(j: Column) -> Column:
        """1/WAPE per ensemble component, from the folds before origin j; 0 when undefined or 0."""
        enough = n - FOLD_MONTHS * j >= FOLD_MONTHS + MIN_TRAIN
        mine = F.filter(F.slice("origins", j + 2, FOLDS), lambda o: o.isNotNull())
        out = []
        for model in ENSEMBLE:
            pairs = F.flatten(F.transform(mine, lambda o: F.arrays_zip(o["actual"].alias("a"), o[model].alias("p"))))
            wape = _errors(pairs)["wape"]
            out.append(F.when(enough & (wape > 0), 1.0 / wape).otherwise(0.0).alias(model))
        return F.struct(*out)

    return rows.withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(FOLDS)), weigh))


def _blend(weights: Column, values: dict[str, Column]) -> Column:
    """Weighted mean of the components; equal weights when none is positive."""
    whole = sum((weights[m] * k for m, k in ENSEMBLE.items()), F.lit(0.0))
    weighted = sum((weights[m] * k * values[m] for m, k in ENSEMBLE.items()), F.lit(0.0)) / whole
    plain = sum((k * values[m] for m, k in ENSEMBLE.items()), F.lit(0.0)) / sum(ENSEMBLE.values())
    return F.when(whole > 0, weighted).otherwise(plain)


def _fold_pairs(method: str) -> Column:
    """(actual, predicted) of all folds of the series for one method."""
    model = COMPUTED_AS.get(method, method)
    n = F.col("n")

    def pairs(j: Column) -> Column:
        o, w = F.get("origins", j), F.get("weights", j)
        if model != "ensemble":
            predicted = o[model]
        else:
            predicted = F.zip_with(o["linear"], o["seasonal_naive"],
                                   lambda a, b: _blend(w, {"linear": a, "seasonal_naive": b}))
        return F.when(o.isNotNull(), F.arrays_zip(o["actual"].alias("a"), predicted.alias("p")))

    enough = n >= FOLD_MONTHS + MIN_TRAIN
    back = F.when(enough, F.sequence(F.lit(FOLDS), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(back, pairs), lambda x: x.isNotNull())


def backtest(history: DataFrame, keys: list[str] = [], methods: list[str] = METHODS) -> DataFrame:
    """Rolling-origin accuracy per series and method, pooled over the folds.

    `scored_as` names the model that was actually run.
    """
    return _backtests(series(history, keys), keys, methods)


def _backtests(rows: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(COMPUTED_AS.get(m, m)).alias("scored_as"),
                                 _fold_pairs(m).alias("folds")) for m in methods])
    long = rows.select(*keys, "n", F.explode(entries).alias("e")).select(
        *keys, "n", "e.method", "e.scored_as", F.size("e.folds").alias("folds"), F.flatten("e.folds").alias("pairs"))
    return long.select(*keys, "n", "method", "scored_as",
                       *[v.alias(k) for k, v in _errors(F.col("pairs")).items()], "folds")


def auto_select(history: DataFrame, keys: list[str] = []) -> DataFrame:
    """Per series the candidate with the lowest WAPE; ties keep candidate order.

    The ARIMA model needs two seasons; without any score the smoothing model is taken.
    """
    return _select(_backtests(series(history, keys), keys, CANDIDATES), keys)


def _select(scores: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(c) for c in CANDIDATES]), F.col("method"))
    allowed = (F.col("method") != "sarima") | (F.col("n") >= MIN_SARIMA_MONTHS)
    usable = F.when(allowed & F.col("wape").isNotNull(), F.struct("wape", rank.alias("rank"), "method"))
    best = scores.groupBy(*keys).agg(F.min(usable).alias("best"))
    return best.select(*keys, F.coalesce("best.method", F.lit("holt_winters")).alias("method"),
                       F.col("best.wape").alias("wape"))


def _residuals(model: str) -> Column:
    y, n = F.col("y"), F.col("n")
    fit = F.get("origins", F.lit(0))["fit"]
    if model == "naive":
        diffs = F.transform(F.slice(y, 2, F.greatest(n - 1, F.lit(0))), lambda v, i: v - F.get(y, i))
        return F.when(n > 1, diffs).otherwise(F.array(F.lit(0.0)))
    if model == "seasonal_naive":
        lagged = F.transform(F.slice(y, SEASON + 1, F.greatest(n - SEASON, F.lit(0))), lambda v, i: v - F.get(y, i))
        return F.when(n < SEASON, _residuals("naive")).otherwise(lagged)
    if model == "linear":
        return F.transform(y, lambda v, i: v - (fit["slope"] * i + fit["level"]))
    return F.concat(*[_residuals(m) for m, k in ENSEMBLE.items() for _ in range(int(k))])


def _sigma(residuals: Column) -> Column:
    """Sample standard deviation, 0 for fewer than two values."""
    k = F.size(residuals)
    mean = _sum(residuals) / k
    squares = _sum(F.transform(residuals, lambda x: (x - mean) * (x - mean)))
    return F.when(k > 1, F.sqrt(squares / (k - 1))).otherwise(0.0)


def _by_method(value) -> Column:
    """`value(model)` of the model behind the row's method."""
    out = None
    for m in METHODS:
        hit = F.col("method") == m
        v = value(COMPUTED_AS.get(m, m))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def _points(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Future months with point forecast and residual spread, for `method` of each row."""
    y, n = F.col("y"), F.col("n")
    rows = rows.withColumn("fit", F.get("origins", F.lit(0))["fit"]).withColumn("w", F.get("weights", F.lit(0)))
    rows = rows.withColumn("residuals", _by_method(_residuals))
    rows = rows.withColumn("sigma", _sigma(F.col("residuals")))
    rows = rows.select(*keys, "method", "y", "n", "fit", "w", "sigma",
                       F.posexplode(future_periods(F.col("last"), horizon)).alias("step", "period"))

    def point(model: str) -> Column:
        step = F.col("step")
        if model != "ensemble":
            return _predict(model, y, n, F.col("fit"), step)
        return _blend(F.col("w"), {m: _predict(m, y, n, F.col("fit"), step) for m in ENSEMBLE})

    return rows.select(*keys, "method", "period", (F.col("step") + 1).alias("step"), "sigma",
                       _by_method(point).alias("yhat"))


def with_interval(points: DataFrame) -> DataFrame:
    """yhat +- z * sigma * sqrt(step), before any repair."""
    fan = F.col("sigma") * F.sqrt(F.col("step").cast("double"))
    return points.withColumns({
        "lo80": F.col("yhat") - Z80 * fan, "hi80": F.col("yhat") + Z80 * fan,
        "lo95": F.col("yhat") - Z95 * fan, "hi95": F.col("yhat") + Z95 * fan})


def repair_bands(df: DataFrame) -> DataFrame:
    """No value below 0 and lo95 <= lo80 <= cost <= hi80 <= hi95."""
    zero = F.lit(0.0)
    df = df.withColumn("cost", F.greatest("yhat", zero))
    df = df.withColumns({"lo80": F.greatest(F.least("lo80", "cost"), zero),
                         "hi80": F.greatest("hi80", "cost", zero)})
    return df.withColumns({"lo95": F.greatest(F.least("lo95", "lo80"), zero),
                           "hi95": F.greatest("hi95", "hi80", zero)})


def forecast_points(history: DataFrame, keys: list[str] = [], horizon: int = 24, method: str = "linear") -> DataFrame:
    """Raw points and residual spread of one method."""
    return _points(series(history, keys).withColumn("method", F.lit(method)), keys, horizon)


def _chosen(rows: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Series rows with their method and its backtest, without leaving the row."""
    if method not in METHODS:
        method = "auto"
    names = CANDIDATES if method == "auto" else [method]
    scored = rows
    for m in dict.fromkeys(COMPUTED_AS.get(c, c) for c in names):
        folds = _fold_pairs(m)
        scored = scored.withColumn(f"_f_{m}", folds)
        errors = _errors(F.flatten(f"_f_{m}"))
        scored = scored.withColumn(f"_s_{m}", F.struct(*[v.alias(k) for k, v in errors.items()],
                                                       F.size(f"_f_{m}").alias("folds")))
    score = {c: F.col(f"_s_{COMPUTED_AS.get(c, c)}") for c in names}
    if method == "auto":
        entries = F.array(*[F.when(
            score[c]["wape"].isNotNull() & ((F.col("n") >= MIN_SARIMA_MONTHS) if c == "sarima" else F.lit(True)),
            F.struct(score[c]["wape"].alias("wape"), F.lit(i).alias("rank"), F.lit(c).alias("method")))
            for i, c in enumerate(CANDIDATES)])
        scored = scored.withColumn("method", F.coalesce(F.array_min(F.array_compact(entries))["method"],
                                                        F.lit("holt_winters")))
    else:
        scored = scored.withColumn("method", F.lit(method))
    picked = None
    for c in names:
        hit = F.col("method") == c
        picked = F.when(hit, score[c]) if picked is None else picked.when(hit, score[c])
    extra = [c for c in scored.columns if c.startswith(("_f_", "_s_"))]
    return scored.withColumn("accuracy", picked).drop(*extra)


def forecast_spend(history: DataFrame, keys: list[str] = [], horizon: int = 24, method: str = "auto") -> DataFrame:
    """Per series `horizon` months with 80 % and 95 % bands; `auto` picks the method."""
    points = _points(_chosen(series(history, keys), keys, method), keys, horizon)
    return repair_bands(with_interval(points)).select(
        *keys, "method", "period", "cost", "lo80", "hi80", "lo95", "hi95")


def forecast_summary(history: DataFrame, keys: list[str] = [], method: str = "auto") -> DataFrame:
    """Per series: chosen method, history length, backtest, maturity band, notes."""
    rows = _chosen(series(history, keys), keys, method)
    wape, n = F.col("accuracy.wape"), F.col("n")
    notes = F.array_compact(F.array(
        F.when(n < MIN_SARIMA_MONTHS, F.format_string("%d months of history; bands are wide", n)),
        F.when(F.lit(method not in [*METHODS, "auto"]), F.lit(f"unknown method {method}, auto was used")),
        F.when(F.col("method").isin("holt_winters", "sarima", "ensemble"), "seasonal model replaced by linear trend"),
        F.when(wape.isNull(), "backtest inconclusive")))
    return rows.select(*keys, "method", F.col("n").alias("n_history"), "accuracy.mape", "accuracy.wape",
                       "accuracy.smape", F.col("accuracy.folds").alias("folds"), maturity(wape).alias("maturity"),
                       notes.alias("notes"))


# --- overlays ------------------------------------------------------------------------------
def commitment_steps(charges: DataFrame, per: str = "purchase") -> DataFrame:
    """(expiry, step): monthly cost coming back when one-year commitments end.

    Each purchase adds its cloud's whole mean monthly discount; `per="provider"` counts a cloud
    once per expiry month. Purchases and discounts come from one monthly report per cloud.
    """
    used = has_commitment() & (F.col("CommitmentDiscountStatus") == "Used")
    bought = has_commitment() & (F.col("ChargeCategory") == "Purchase")
    report = charges.filter((used | bought) & F.col("ProviderName").isNotNull()).groupBy("ProviderName", month().alias("m")).agg(
        F.sum(F.when(used, F.col(LIST) - F.col(COST))).cast("double").alias("discount"),
        F.count_if(used).alias("used_rows"), F.count_if(bought).alias("purchases"))
    cloud = Window.partitionBy("ProviderName")
    used_months = F.greatest(F.count_if(F.col("used_rows") > 0).over(cloud), F.lit(1))
    lost = F.coalesce(F.sum("discount").over(cloud), F.lit(0.0)) / used_months
    times = F.col("purchases") if per == "purchase" else F.lit(1)
    return (report.withColumn("lost", lost).filter((F.col("purchases") > 0) & (F.col("lost") > 0))
            .groupBy(F.add_months("m", 12).alias("expiry")).agg(F.sum(F.col("lost") * times).alias("step")))


def commitment_expiry_overlay(charges: DataFrame, forecast: DataFrame, per: str = "purchase") -> DataFrame:
    """Forecast plus `cost_with_cliffs` and `cliff`.

    From its expiry month on, each step stays: a running sum over forecast and expiry months, with the forecast's rows
    of a month beside it, so the forecast is made once and no join is needed. Expiries outside the forecast do not count.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in forecast.columns])
    planned = forecast.select(F.trunc("period", "month").alias("m"), row.alias("row"), F.lit(0.0).alias("step"))
    steps = commitment_steps(charges, per).select(F.col("expiry").alias("m"), F.lit(None).cast(planned.schema["row"].dataType).alias("row"), "step")
    estate = Window.partitionBy()
    months = planned.union(steps).withColumns({
        "lo": F.min(F.when(F.col("row").isNotNull(), F.col("m"))).over(estate),
        "hi": F.max(F.when(F.col("row").isNotNull(), F.col("m"))).over(estate)}).filter("m >= lo and m <= hi")
    months = months.groupBy("m").agg(F.sum("step").alias("step"), F.bool_or(F.col("row").isNull()).alias("cliff"),
                                     F.collect_list("row").alias("rows"))
    run = Window.partitionBy().orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    out = months.withColumn("added", F.sum("step").over(run)).select(F.explode("rows").alias("row"), "added", "cliff")
    return out.select("row.*", (F.col("row.cost") + F.col("added")).alias("cost_with_cliffs"), "cliff")


def _adjustment(entry: dict) -> tuple[str, float, str] | None:
    """(first month, relative change, label) or None for an unusable entry."""
    try:
        year, mon = str(entry["period"])[:7].split("-")
        first = f"{int(year):04d}-{int(mon):02d}-01"
        change = float(entry["pct"])
    except (KeyError, ValueError, TypeError):
        return None
    if not 1 <= int(mon) <= 12:
        return None
    return first, change, str(entry.get("label", f"{change:+.0%} from {entry['period']}"))


def driver_overlay(forecast: DataFrame, adjustments: list[dict]) -> DataFrame:
    """Permanent relative steps from a month on, compounding; labels of those in force.

    The adjustments are a planner's short list, so they become one expression.
    """
    good = [a for a in map(_adjustment, adjustments) if a]
    factor, labels = F.lit(1.0), [F.lit(None).cast("string")]
    for first, change, label in good:
        on = F.trunc("period", "month") >= F.lit(first).cast("date")
        factor = factor * F.when(on, 1.0 + change).otherwise(1.0)
        labels.append(F.when(on, label))
    return (forecast.withColumn("cost_adjusted", F.col("cost") * factor)
            .withColumn("applied_drivers", F.array_compact(F.array(*labels))))


def cliff_summary(overlay: DataFrame) -> DataFrame:
    """Cliff months, extra cost, forecast with and without."""
    months = F.array_sort(F.collect_list(F.when(F.col("cliff"), F.date_format("period", "yyyy-MM"))))
    return overlay.agg(
        months.alias("cliff_months"),
        F.round(F.sum("cost_with_cliffs") - F.sum("cost"), 2).alias("extra_usd"),
        F.round(F.sum("cost"), 2).alias("baseline_forecast_usd"),
        F.round(F.sum("cost_with_cliffs"), 2).alias("with_cliffs_usd"))


def estate_forecast(charges: DataFrame, horizon: int = 24, method: str = "auto") -> DataFrame:
    return forecast_spend(monthly(charges), [], horizon, method)
