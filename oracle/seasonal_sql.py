"""Statements of the seasonal models: smoothing and forecasts as recursive tables, regressions as list sums."""

from __future__ import annotations

from oracle.sql import CHARGES, DAILY, HIST, KEYS, R, SQL

YEARLY = """sy AS (SELECT p, s, n, MAX(period) AS last, regr_slope(cost, t) AS b, regr_intercept(cost, t) AS a, list(cost ORDER BY t) AS y,
  len(list_filter(list(cost), lambda v: v <= 0)) = 0 AS mul FROM h GROUP BY p, s, n),
si AS (SELECT *, list_sum(y[1:12]) / 12 AS m1, list_sum(y[13:24]) / 12 AS m2 FROM sy),
ls AS (SELECT h.p, h.s, COALESCE(stddev_samp(cost - (b * t + a)), 0) AS line_sigma FROM h JOIN sy ON h.p = sy.p AND h.s = sy.s GROUP BY 1, 2)"""


def _add(name: str, body: str, *ctes: str) -> None:
    SQL[name] = "WITH RECURSIVE " + ",\n".join([CHARGES, HIST, YEARLY, *ctes]) + "\n" + body


def _smooth(name: str, grid: str) -> str:
    """`name`: the state of every parameter row of `grid` (p, s, i, alpha, beta, gamma, phi) after every month."""
    return f"""{name} AS (
  SELECT g.p, g.s, i, alpha, beta, gamma, phi, n, y, mul, 0 AS t, m1 AS lv, (m2 - m1) / 12 AS tr,
    list_transform(y[1:12], lambda v: CASE WHEN mul THEN v / m1 ELSE v - m1 END) AS q, 0.0::DOUBLE AS sse, 0.0::DOUBLE AS es
  FROM {grid} g JOIN si ON si.p = g.p AND si.s = g.s WHERE n >= 24
  UNION ALL
  SELECT p, s, i, alpha, beta, gamma, phi, n, y, mul, t + 1, nl, beta * (nl - lv) + (1 - beta) * phi * tr,
    list_append(q[2:12], gamma * CASE WHEN mul THEN v / nl ELSE v - nl END + (1 - gamma) * q[1]), sse + (v - f) * (v - f), es + (v - f)
  FROM (SELECT *, CASE WHEN mul THEN base * q[1] ELSE base + q[1] END AS f,
      alpha * CASE WHEN mul THEN v / q[1] ELSE v - q[1] END + (1 - alpha) * base AS nl
    FROM (SELECT *, y[t + 1] AS v, lv + phi * tr AS base FROM {name} WHERE t < n)))"""


_add("F06_holt_winters", f"""SELECT {KEYS}, CASE WHEN lv IS NULL THEN 'linear' WHEN mul THEN 'holt_winters_multiplicative' ELSE 'holt_winters_additive' END AS computed_as,
  {R('alpha')} AS alpha, {R('beta')} AS beta, {R('gamma')} AS gamma, {R('phi')} AS phi,
  CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS period, step, {R('CASE WHEN lv IS NULL THEN line_sigma ELSE sqrt(greatest(sse - es * es / n, 0) / (n - 1)) END', 2)} AS sigma,
  {R('CASE WHEN lv IS NULL THEN a + b * (n - 1 + step) WHEN mul THEN base * q[(step - 1) % 12 + 1] ELSE base + q[(step - 1) % 12 + 1] END', 2)} AS yhat
FROM (SELECT sy.p, sy.s, sy.n, sy.last, sy.a, sy.b, sy.mul, line_sigma, lv, q, alpha, beta, gamma, phi, sse, es, step,
    lv + phi * (1 - power(phi, step)) / (1 - phi) * tr AS base
  FROM sy JOIN ls ON ls.p = sy.p AND ls.s = sy.s CROSS JOIN steps LEFT JOIN won ON won.p = sy.p AND won.s = sy.s)""",
     """grid AS (SELECT p, s, x * 18 + z * 6 + g * 2 + d AS i, ([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[])[x + 1] AS alpha, ([0.05, 0.2, 0.4]::DOUBLE[])[z + 1] AS beta,
  ([0.05, 0.2, 0.4]::DOUBLE[])[g + 1] AS gamma, ([0.9, 0.98]::DOUBLE[])[d + 1] AS phi FROM si, range(5) r1(x), range(3) r2(z), range(3) r3(g), range(2) r4(d))""",
     _smooth("hw", "grid"),
     """near AS (SELECT * FROM hw WHERE t = n AND sse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p, s ORDER BY sse, i) = 1),
finer AS (SELECT p, s, x * 9 + z * 3 + g AS i, least(greatest(alpha + ([-0.1, 0.0, 0.1]::DOUBLE[])[x + 1], 0.01), 0.99) AS alpha,
  least(greatest(beta + ([-0.04, 0.0, 0.04]::DOUBLE[])[z + 1], 0.01), 0.99) AS beta,
  least(greatest(gamma + ([-0.04, 0.0, 0.04]::DOUBLE[])[g + 1], 0.01), 0.99) AS gamma, phi FROM near, range(3) r1(x), range(3) r2(z), range(3) r3(g))""",
     _smooth("hx", "finer"),
     "won AS (SELECT * FROM hx WHERE t = n AND sse IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p, s ORDER BY sse, i) = 1)")


def _dot(x: str, y: str) -> str:
    return f"list_sum(list_transform(range(1, len({x}) + 1), lambda j: {x}[j] * {y}[j]))"


def _coefficients(target: str, columns: list[str], source: str, out: str) -> str:
    """A table with `out`, the three coefficients of `target` (zeros where none are sound), beside all of `source`."""
    sums = [f"{_dot(x, y)} AS a{i}{j}" for i, x in enumerate(columns) for j, y in enumerate(columns)]
    sums += [f"{_dot(x, target)} AS d{i}" for i, x in enumerate(columns)]

    def det(m: list[list[str]]) -> str:
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    whole = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
    swapped = [[[f"d{i}" if j == k else f"a{i}{j}" for j in range(3)] for i in range(3)] for k in range(3)]
    made = ", ".join([f"a{i}{j}" for i in range(3) for j in range(3)] + ["d0", "d1", "d2"])
    solved = ", ".join(f"{det(m)} / {det(whole)}" for m in swapped)
    return f"""(SELECT * EXCLUDE (x), CASE WHEN len(list_filter(x, lambda v: v IS NOT NULL AND abs(v) < 1)) = 3 THEN x ELSE [0.0, 0.0, 0.0]::DOUBLE[] END AS {out}
  FROM (SELECT * EXCLUDE ({made}), [{solved}] AS x FROM (SELECT *, {', '.join(sums)} FROM {source})))"""


_LISTS = "list_transform(range(1, greatest(k - {first}, 0) + 1), lambda j: {array}[j + {first} - {lag}])"


def _lists(names: list[tuple[str, str, int]], first: int) -> str:
    return ", ".join(f"{_LISTS.format(first=first, array=array, lag=lag)} AS {name}" for name, array, lag in names)


_add("F07_seasonal_arima", f"""SELECT sy.p AS ProviderName, sy.s AS ServiceCategory, CASE WHEN c IS NULL THEN 'linear' ELSE 'arima' END AS computed_as,
  {R('c[1]')} AS ar, {R('c[2]')} AS ma, {R('c[3]')} AS seasonal_ma, CAST(sy.last + to_months(CAST(steps.step AS INTEGER)) AS DATE) AS period, steps.step AS step,
  {R('CASE WHEN c IS NULL THEN line_sigma ELSE COALESCE(spread, 0) END', 2)} AS sigma,
  {R('CASE WHEN c IS NULL THEN sy.a + sy.b * (sy.n - 1 + steps.step) ELSE path.yy[sy.n + steps.step] END', 2)} AS yhat
FROM sy JOIN ls ON ls.p = sy.p AND ls.s = sy.s CROSS JOIN steps LEFT JOIN (SELECT * FROM path WHERE step = 14) path ON path.p = sy.p AND path.s = sy.s""",
     f"""ws AS (SELECT p, s, n, y, n - 13 AS k, list_transform(range(14, n + 1), lambda i: (y[i] - y[i - 1]) - (y[i - 12] - y[i - 13])) AS w FROM sy WHERE n >= 24),
wt AS (SELECT *, {_lists([('t0', 'w', 0), ('t1', 'w', 1), ('t2', 'w', 2), ('t3', 'w', 3)], 3)} FROM ws),
wl AS {_coefficients('t0', ['t1', 't2', 't3'], 'wt', 'l')},
we AS (SELECT p, s, n, y, k, w, [0.0, 0.0, 0.0]::DOUBLE[] || list_transform(range(1, len(t0) + 1), lambda j: t0[j] - (l[1] * t1[j] + l[2] * t2[j] + l[3] * t3[j])) AS e FROM wl),
wu AS (SELECT *, {_lists([('u0', 'w', 0), ('u1', 'w', 1), ('u2', 'e', 1), ('u3', 'e', 12)], 15)} FROM we),
wc AS {_coefficients('u0', ['u1', 'u2', 'u3'], 'wu', 'c')},
wr AS (SELECT *, CASE WHEN len(u0) > 1 THEN list_aggregate(list_transform(range(1, len(u0) + 1), lambda j: u0[j] - (c[1] * u1[j] + c[2] * u2[j] + c[3] * u3[j])), 'stddev_samp')
  ELSE list_aggregate(w, 'stddev_samp') END AS spread FROM wc),
path AS (SELECT p, s, n, k, c, e, spread, 0 AS step, y AS yy, w AS ww FROM wr
  UNION ALL SELECT p, s, n, k, c, e, spread, step + 1, list_append(yy, nw + yy[-1] + yy[-12] - yy[-13]), list_append(ww, nw)
  FROM (SELECT *, c[1] * ww[-1] + c[2] * COALESCE(e[k + step], 0) + c[3] * COALESCE(e[k + step - 11], 0) AS nw FROM path WHERE step < 14))""")


# --- seasonal-trend decomposition of daily series ------------------------------------------------------------
_W = "OVER (PARTITION BY k ORDER BY period)"


def _line(source: str, value: str, weight: str | None, half: int, step: int, out: str) -> str:
    """`source` with `out`, a local weighted line at every row."""
    offsets = [d * step for d in range(-half, half + 1)]
    cube = {d: (1 - (abs(d) / ((half + 1) * step)) ** 3) ** 3 for d in offsets}
    at = {d: f"LAG({value}, {-d}) {_W}" for d in offsets}
    own = {d: f" * LAG({weight}, {-d}) {_W}" if weight else "" for d in offsets}
    near = ", ".join(f"{at[d]} AS y{i}, {cube[d]!r}::DOUBLE{own[d]} AS w{i}" for i, d in enumerate(offsets))
    parts = ", ".join(f"CASE WHEN y{i} IS NULL THEN 0.0::DOUBLE ELSE w{i} END AS g{i}" for i in range(len(offsets)))
    total = lambda term: " + ".join(["0.0::DOUBLE", *[term(i, float(d)) for i, d in enumerate(offsets)]])
    s0, s1, s2 = total(lambda i, d: f"g{i}"), total(lambda i, d: f"g{i} * {d}::DOUBLE"), total(lambda i, d: f"g{i} * {d * d}::DOUBLE")
    t0, t1 = total(lambda i, d: f"g{i} * COALESCE(y{i}, 0)"), total(lambda i, d: f"g{i} * {d}::DOUBLE * COALESCE(y{i}, 0)")
    ys = ", ".join(f"y{i}, w{i}" for i in range(len(offsets)))
    gs = ", ".join(f"g{i}" for i in range(len(offsets)))
    return f"""(SELECT * EXCLUDE (s0, s1, s2, t0, t1), CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)
WHEN s0 > 1e-9 THEN t0 / s0 ELSE {value} END AS {out}
FROM (SELECT * EXCLUDE ({ys}, {gs}), {s0} AS s0, {s1} AS s1, {s2} AS s2, {t0} AS t0, {t1} AS t1
FROM (SELECT *, {parts} FROM (SELECT *, {near} FROM {source}))))"""


def _mean(source: str, value: str, half: int, out: str) -> str:
    total = " + ".join(["0.0::DOUBLE", *[f"LAG({value}, {-d}) {_W}" for d in range(-half, half + 1)]])
    return f"(SELECT *, ({total}) / {2 * half + 1} AS {out} FROM {source})"


_CTES, _source, _weight = [DAILY("ServiceCategory"), "st0 AS (SELECT period, k, cost, 0.0::DOUBLE AS trend, 0.0::DOUBLE AS seasonal FROM dl)"], "st0", None
for _i in range(4):
    if _i >= 2:
        _CTES.append(f"""rb{_i} AS (SELECT * EXCLUDE (o, m), CASE WHEN m <= 1e-12 THEN 1.0::DOUBLE WHEN o / m < 1 THEN (1 - (o / m) * (o / m)) * (1 - (o / m) * (o / m)) ELSE 0 END AS rw
FROM (SELECT *, 6 * median(o) OVER (PARTITION BY k) AS m FROM (SELECT *, ABS(cost - seasonal - trend) AS o FROM {_source})))""")
        _source, _weight = f"rb{_i}", "rw"
    _CTES.append(f"cy{_i} AS {_line(f'(SELECT *, cost - trend AS dt0 FROM {_source})', 'dt0', _weight, 3, 7, 'cyc')}")
    _CTES.append(f"mv{_i} AS {_mean(_mean(_mean(f'cy{_i}', 'cyc', 3, 'm1'), 'm1', 3, 'm2'), 'm2', 1, 'm3')}")
    _CTES.append(f"""fl{_i} AS (SELECT * EXCLUDE (m3), COALESCE(m3, last_value(m3 IGNORE NULLS) OVER (PARTITION BY k ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(m3 IGNORE NULLS) OVER (PARTITION BY k ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS m3 FROM mv{_i})""")
    _CTES.append(f"lw{_i} AS {_line(f'fl{_i}', 'm3', None, 4, 1, 'low')}")
    _CTES.append(f"se{_i} AS (SELECT period, k, cost, cyc - low AS seasonal, cost - (cyc - low) AS rest{', rw' if _weight else ''} FROM lw{_i})")
    _CTES.append(f"st{_i + 1} AS (SELECT period, k, cost, seasonal, trend FROM {_line(f'se{_i}', 'rest', _weight, 7, 1, 'trend')})")
    _source = f"st{_i + 1}"
SQL["D02_stl"] = "WITH " + ",\n".join([CHARGES, *_CTES, """x1 AS (SELECT period, k, cost, COUNT(*) OVER (PARTITION BY k) AS n, seasonal + trend AS own,
quantile_cont(cost, 0.5) OVER (PARTITION BY k ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM st4),
x2 AS (SELECT period, k, cost, n, CASE WHEN n < 10 THEN cost WHEN n >= 14 THEN own ELSE near END AS expected FROM x1),
x3 AS (SELECT *, cost - expected AS residual, median(cost - expected) OVER (PARTITION BY k) AS mr FROM x2),
x4 AS (SELECT *, median(ABS(residual - mr)) OVER (PARTITION BY k) AS mad, COALESCE(NULLIF(stddev_samp(residual) OVER (PARTITION BY k), 0), 1) AS sd FROM x3)"""]) + f"""
SELECT period, k AS ServiceCategory, {R('expected', 4)} AS expected, n >= 10 AND ABS(0.6745 * residual / (CASE WHEN mad > 0 THEN mad ELSE sd END)) > 3.5
AND ABS(CASE WHEN ABS(expected) > 1e-9 THEN residual / expected * 100.0 ELSE 0 END) >= 25 AND cost >= 0 AS is_anomaly FROM x4"""
