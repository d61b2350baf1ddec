"""The queries restated as SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from spendframe.functions.focus import COLUMNS, MANDATORY, NOT_NULLABLE
from spendframe.operators.levers import LEVERS
from spendframe.sources.testcharges import CHARGES_SQL, FEED_SQL

SQL: dict[str, str] = {}

M = "CAST(date_trunc('month', ChargePeriodStart) AS DATE)"
CHARGES = f"charges AS ({CHARGES_SQL})"
FEED = f"feed AS ({FEED_SQL.replace('{charges}', 'charges')})"


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def SUM(x: str, when: str | None = None) -> str:
    """Sum as double, 0 for nothing."""
    return f"COALESCE({D(f'SUM({x})' + (f' FILTER (WHERE {when})' if when else ''))}, 0)"


def R(x: str, n: int = 6) -> str:
    return f"(ROUND({x}, {n}) + 0.0::DOUBLE)"


def add(name: str, body: str, *ctes: str) -> None:
    SQL[name] = "WITH " + ",\n".join([CHARGES, *ctes]) + "\n" + body


USAGE = "ChargeCategory = 'Usage'"
HAS = "CommitmentDiscountId IS NOT NULL"
ELIGIBLE = ("ChargeCategory = 'Usage' AND ServiceCategory IN ('Compute','Databases','AI and Machine Learning','Analytics')"
            " AND PricingCategory IS DISTINCT FROM 'Dynamic'")

# --- sources ---------------------------------------------------------------------------------
add("S02_date_guard", """SELECT ProviderName, COUNT(*) AS rows FROM charges
WHERE charge_key % 5 <> 0 AND ChargePeriodStart >= DATE '2000-01-01' AND ChargePeriodStart < DATE '2001-01-01' GROUP BY 1""")
add("S07_bounded_scan", f"""SELECT ProviderName, COUNT(*) AS rows, MIN(ChargePeriodStart) AS first_day, {SUM('EffectiveCost')} AS cost
FROM charges WHERE ProviderName IN ('AWS','GCP') AND ChargePeriodStart >= DATE '2002-06-15' - INTERVAL 25 MONTH GROUP BY 1""")
add("S08_opportunity_window", f"""SELECT ProviderName, COUNT(*) AS rows, MIN(ChargePeriodStart) AS first_day, {SUM('EffectiveCost')} AS cost
FROM charges WHERE ChargePeriodStart >= DATE '2001-09-30' - INTERVAL 24 MONTH GROUP BY 1""")
_IN = ("((ProviderName = 'AWS' AND ChargePeriodStart BETWEEN DATE '2001-01-01' AND DATE '2001-06-30') OR "
       "(ProviderName = 'GCP' AND ChargePeriodStart BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'))")
add("S11_replaced_windows", f"""SELECT ProviderName AS _binding, COUNT(*) AS rows, MIN(ChargePeriodStart) AS first_day,
{SUM(f'CASE WHEN {_IN} THEN 2 * EffectiveCost ELSE EffectiveCost END')} AS cost FROM charges WHERE NOT {_IN} OR charge_key % 3 = 0 GROUP BY 1""")
add("S13_late_rows", f"""SELECT ProviderName AS _binding, COUNT(*) AS rows, MIN(ChargePeriodStart) AS first_day, {SUM('EffectiveCost')} AS cost
FROM charges WHERE ChargePeriodStart < DATE '2001-09-30' OR charge_key % 4 <> 0 GROUP BY 1""")
add("S15_bindings_union", f"""SELECT _binding, tag_application, COUNT(*) AS rows, {SUM('EffectiveCost')} AS cost FROM feed f
WHERE NOT EXISTS (SELECT 1 FROM feed g WHERE g._binding = f._binding AND (g.InvoiceIssuerName IS NULL OR g.ChargeClass IS NOT NULL
  OR (g.ChargeCategory = 'Purchase' AND g.ChargeFrequency = 'Usage-Based') OR (g.CommitmentDiscountId IS NOT NULL AND g.CommitmentDiscountType IS NULL)))
GROUP BY 1, 2""", FEED)
add("S14_month_slices", """SELECT binding, CAST(GREATEST(s, m) AS DATE) AS lo, CAST(LEAST(e, m + INTERVAL 1 MONTH) AS DATE) AS hi FROM (
  SELECT ProviderName AS binding, MIN(ChargePeriodStart) + 9 AS s, MAX(ChargePeriodStart) + 1 AS e FROM charges GROUP BY 1) r,
  (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS m) x
WHERE m < e AND m + INTERVAL 1 MONTH > s""")
add("S16_issuer_stamp", """SELECT 'empty' AS feed, 'Vendor' AS InvoiceIssuerName, COUNT(*) AS rows FROM charges
UNION ALL SELECT 'partly', CASE WHEN charge_key % 2 = 0 THEN 'Given' END, COUNT(*) FROM charges GROUP BY 2""")

# --- normalise and validate -------------------------------------------------------------------
add("N01_alias_rename", f"""SELECT ProviderName, ChargeCategory, {SUM('EffectiveCost')} AS cost, SUM(ConsumedQuantity) AS quantity,
CAST(-COUNT(*) AS DOUBLE) AS extra FROM charges GROUP BY 1, 2""")
_HAVE = ["ProviderName", "ServiceCategory", "ChargeCategory", "ServiceName", "RegionId", "SubAccountId", "ChargePeriodStart",
         "ChargePeriodEnd", "ListCost", "EffectiveCost", "CommitmentDiscountId", "CommitmentDiscountStatus", "PricingCategory",
         "ConsumedQuantity", "ResourceType", "ResourceId", "SkuId", "Tags"]
_EXTRA = ["charge_key", "tag_application", "tag_business_unit", "tag_environment"]
add("N02_conform", "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", {f'COUNT({c})' if c in _HAVE + _EXTRA else '0 * COUNT(*)'} AS filled FROM charges"
    for i, c in enumerate(COLUMNS + _EXTRA)))
add("N03_tolerant_cast", f"""SELECT ProviderName, {SUM('EffectiveCost', 'charge_key % 7 > 1')} AS cost,
COUNT(*) FILTER (WHERE charge_key % 7 > 1) AS costs, COUNT(*) FILTER (WHERE charge_key % 5 > 1) AS dates,
MAX(ChargePeriodStart) FILTER (WHERE charge_key % 5 > 1) AS last FROM charges GROUP BY 1""")
add("N04_tag_key_fold", """SELECT raw_key, CASE replace(replace(lower(trim(raw_key)), '-', '_'), ' ', '_')
  WHEN 'application' THEN 'application' WHEN 'app' THEN 'application' WHEN 'app_name' THEN 'application'
  WHEN 'bu' THEN 'business_unit' WHEN 'env' THEN 'environment' END AS tag_key, COUNT(*) AS rows
FROM (SELECT unnest(json_keys(Tags)) AS raw_key FROM charges WHERE Tags <> 'not json') GROUP BY 1, 2""")
add("N05_tag_explode", """SELECT tag_application, tag_business_unit, tag_environment, 'Unallocated' AS tag_cost_center,
'Unallocated' AS tag_owner, 'Unallocated' AS tag_project, COUNT(*) AS rows FROM charges GROUP BY 1, 2, 3""")
add("N06_tag_serialise", """SELECT CASE WHEN Tags = 'not json' THEN '{}' ELSE replace(replace(Tags, '": "', '":"'), '", "', '","') END AS Tags,
COUNT(*) AS rows FROM charges GROUP BY 1""")
add("N07_missing_columns", "SELECT DISTINCT ProviderName, 'error' AS severity, c AS \"column\" FROM charges, (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in MANDATORY if c not in _HAVE) + "]) AS c)")


def _issue(severity: str, rule: str, column: str, when: str, sample: str = "NULL") -> str:
    return (f"SELECT _binding, '{severity}' AS severity, '{rule}' AS rule, '{column}' AS \"column\", COUNT(*) AS n, "
            f"{sample} AS sample FROM feed WHERE {when} GROUP BY _binding")


_SAMPLE = ("(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT ChargeClass AS v FROM feed i "
           "WHERE i._binding = feed._binding AND ChargeClass IS NOT NULL))")
ISSUES = {
    "N08_null_errors": "\nUNION ALL ".join(_issue("error", "null", c, f"{c} IS NULL", "CAST(NULL AS VARCHAR)") for c in NOT_NULLABLE),
    "N09_enum_errors": _issue("error", "enum", "ChargeClass", "ChargeClass <> 'Correction'", _SAMPLE),
    "N10_cross_column": _issue("error", "purchase_usage_based", "ChargeFrequency",
                               "ChargeCategory = 'Purchase' AND ChargeFrequency = 'Usage-Based'", "CAST(NULL AS VARCHAR)")
    + "\nUNION ALL " + _issue("error", "commitment_type", "CommitmentDiscountType", f"{HAS} AND CommitmentDiscountType IS NULL"),
    "N11_subcategory_pairs": """SELECT _binding, 'warning' AS severity, 'subcategory' AS rule, 'ServiceSubcategory' AS "column", COUNT(*) AS n,
ServiceCategory || ' / ' || ServiceSubcategory AS sample FROM feed
WHERE (ServiceCategory = 'Storage' AND ServiceSubcategory = 'Virtual Machines')
   OR (ServiceCategory = 'Databases' AND ServiceSubcategory = 'Search') GROUP BY ALL""",
    "N12_recommended_null": """SELECT _binding, 'warning' AS severity, 'all_null' AS rule, 'AvailabilityZone' AS "column", COUNT(*) AS n,
CAST(NULL AS VARCHAR) AS sample FROM feed GROUP BY 1
UNION ALL SELECT _binding, 'warning', 'all_null', 'ChargeFrequency', COUNT(*), NULL FROM feed WHERE _binding = 'GCP' GROUP BY 1""",
}
for _name, _body in ISSUES.items():
    add(_name, _body, FEED)
add("N13_verdict", f"""SELECT _binding, month, row_count, errors, warnings, errors = 0 AS ok FROM (
SELECT _binding, {M} AS month, COUNT(*) AS row_count,
  CAST(MAX(CASE WHEN InvoiceIssuerName IS NULL THEN 1 ELSE 0 END) + MAX(CASE WHEN ChargeClass IS NOT NULL THEN 1 ELSE 0 END)
  + MAX(CASE WHEN ChargeCategory = 'Purchase' AND ChargeFrequency = 'Usage-Based' THEN 1 ELSE 0 END)
  + MAX(CASE WHEN {HAS} AND CommitmentDiscountType IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(1 + MIN(CASE WHEN ChargeFrequency IS NULL THEN 1 ELSE 0 END) + MIN(CASE WHEN ServiceSubcategory IS NULL THEN 1 ELSE 0 END)
  + MAX(CASE WHEN ServiceCategory = 'Storage' AND ServiceSubcategory = 'Virtual Machines' THEN 1 ELSE 0 END)
  + MAX(CASE WHEN ServiceCategory = 'Databases' AND ServiceSubcategory = 'Search' THEN 1 ELSE 0 END) AS BIGINT) AS warnings
FROM feed GROUP BY 1, 2)""", FEED)

# --- budgets (also used below) --------------------------------------------------------------------
BUDGETS = f"""act AS (SELECT {M} AS period, ProviderName AS cloud, tag_application AS application, {D('SUM(EffectiveCost)')} AS actual
  FROM charges WHERE {USAGE} GROUP BY 1, 2, 3),
first_month AS (SELECT MIN(period) AS f FROM act),
base AS (SELECT cloud, application, AVG(actual) AS base FROM act, first_month WHERE period <= f + INTERVAL 11 MONTH GROUP BY 1, 2),
budgets AS (SELECT period, cloud, application, COALESCE(base, actual) * POWER(1.06, date_diff('day', f, period) / 30.44 / 12.0) AS budget
  FROM act CROSS JOIN first_month LEFT JOIN base USING (cloud, application))"""

# --- roll-ups ---------------------------------------------------------------------------------------
COST = f"{D('SUM(EffectiveCost)')} AS cost"
add("P01_scope_filter", f"""SELECT ProviderName, tag_application, COUNT(*) AS rows, {COST} FROM charges
WHERE ChargePeriodStart BETWEEN DATE '2000-03-01' AND DATE '2001-03-15' AND ProviderName IN ('AWS','Azure')
AND tag_application IN ('app-1','app-2','app-5') AND tag_environment IN ('prod','dr') GROUP BY 1, 2""")
add("P02_budget_scope", f"""SELECT period, cloud, application, {R('budget', 2)} AS budget FROM budgets
WHERE cloud = 'AWS' AND application IN ('app-1','app-2')""", BUDGETS)
_DIMS = {"cloud": "ProviderName", "service_category": "ServiceCategory", "service": "ServiceName", "region": "RegionId",
         "sub_account": "SubAccountId", "application": "tag_application", "business_unit": "tag_business_unit",
         "environment": "tag_environment", "charge_category": "ChargeCategory"}
add("P03_dimension_totals", "\nUNION ALL ".join(
    f"SELECT '{n}' AS dimension, {c} AS value, {COST} FROM charges GROUP BY 2" for n, c in _DIMS.items()))
add("P04_monthly_spend", f"SELECT {M} AS period, {COST} FROM charges GROUP BY 1")
add("P05_monthly_by_dimension", f"SELECT {M} AS period, RegionId, {COST} FROM charges GROUP BY 1, 2")
add("P06_daily_spend", f"SELECT ChargePeriodStart AS period, {COST} FROM charges GROUP BY 1")
add("P07_daily_grain", f"""SELECT ChargePeriodStart AS period, ServiceCategory, {COST} FROM charges
WHERE date_diff('day', ChargePeriodStart, ChargePeriodEnd) <= 2 GROUP BY 1, 2""")
add("P08_filter_values", """SELECT DISTINCT 'clouds' AS k, ProviderName AS v FROM charges UNION ALL
SELECT DISTINCT 'applications', tag_application FROM charges UNION ALL
SELECT DISTINCT 'business_units', tag_business_unit FROM charges UNION ALL
SELECT DISTINCT 'environments', tag_environment FROM charges""")
add("P09_provenance", """SELECT COUNT(*) AS rows, MIN(ChargePeriodStart) AS period_start, MAX(ChargePeriodStart) AS period_end,
COUNT(*) FILTER (WHERE InvoiceIssuerName IS NULL OR ChargeClass IS NOT NULL) = 0 AS conformant FROM feed""", FEED)
add("P10_trailing_breakdown", """SELECT ServiceName, CAST(c AS DOUBLE) AS cost, CAST((SELECT SUM(c) FROM t) AS DOUBLE) AS total_usd
FROM t""",
    "t AS (SELECT ServiceName, SUM(EffectiveCost) AS c FROM charges WHERE ChargePeriodStart >= DATE '2000-08-01' GROUP BY 1)")
add("P11_top_and_other", """SELECT CASE WHEN rn < 8 OR n <= 8 THEN tag_application ELSE 'Other' END AS tag_application,
NOT (rn < 8 OR n <= 8) AS folded, CAST(SUM(c) AS DOUBLE) AS cost FROM (
  SELECT *, row_number() OVER (ORDER BY c DESC, tag_application) AS rn, COUNT(*) OVER () AS n FROM (
    SELECT tag_application, SUM(EffectiveCost) AS c FROM charges GROUP BY 1)) GROUP BY 1, 2""")
add("P12_dense_matrix", f"""SELECT tag_application, month, COALESCE(CAST(c AS DOUBLE), 0) AS cost
FROM (SELECT DISTINCT tag_application FROM charges) a
CROSS JOIN (SELECT DISTINCT {M} AS month FROM charges) b
LEFT JOIN (SELECT tag_application, {M} AS month, SUM(EffectiveCost) AS c FROM charges GROUP BY 1, 2) d USING (tag_application, month)""")
add("P13_hierarchy", f"""SELECT 2 AS level, ProviderName AS level1, RegionId AS level2, {COST} FROM charges WHERE RegionId IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 1, ProviderName, NULL, {COST} FROM charges GROUP BY 2
UNION ALL SELECT 0, NULL, NULL, {COST} FROM charges""")
add("P14_drill_down", f"SELECT {M} AS period, {COST} FROM charges WHERE tag_application = 'app-3' GROUP BY 1")

# --- KPIs --------------------------------------------------------------------------------------------
MONTHS = f"months AS (SELECT {M} AS period, {COST} FROM charges GROUP BY 1)"
DELTAS = f"""deltas AS (SELECT period, cost,
 {R("100.0 * (cost - LAG(cost) OVER (ORDER BY period)) / NULLIF(LAG(cost) OVER (ORDER BY period), 0)")} AS mom_pct,
 {R("100.0 * (cost - LAG(cost, 12) OVER (ORDER BY period)) / NULLIF(LAG(cost, 12) OVER (ORDER BY period), 0)")} AS yoy_pct FROM months)"""
BURN = "CAST(SUM(EffectiveCost) AS DOUBLE) / GREATEST(date_diff('day', MIN(ChargePeriodStart), MAX(ChargePeriodEnd)), 1)"
_ul, _uc = SUM("ListCost", USAGE), SUM("EffectiveCost", USAGE)
COVERAGE = f"100.0 * {SUM('ListCost', ELIGIBLE + ' AND ' + HAS)} / NULLIF({SUM('ListCost', ELIGIBLE)}, 0)"
_used, _unused = (SUM("EffectiveCost", f"{HAS} AND CommitmentDiscountStatus = '{s}'") for s in ("Used", "Unused"))
UTIL = f"100.0 * {_used} / NULLIF({_used} + {_unused}, 0)"
ESR = f"100.0 * ({_ul} - {_uc}) / NULLIF({_ul}, 0)"
_cl, _cc = SUM("ListCost", f"{USAGE} AND {HAS}"), SUM("EffectiveCost", f"{USAGE} AND {HAS}")
DISCOUNT = f"100.0 * ({_cl} - {_cc}) / NULLIF({_cl}, 0)"
IMPLIED = f"({UTIL}) / 100 * ({COVERAGE}) / 100 * ({DISCOUNT}) / 100 * 100"
MONTHS_OBSERVED = "GREATEST(date_diff('day', MIN(ChargePeriodStart), MAX(ChargePeriodStart)) / 30.44, 1.0)"
ALLOCATED = f"100.0 * {SUM('EffectiveCost', "tag_application <> 'Unallocated'")} / NULLIF({SUM('EffectiveCost')}, 0)"


def READY(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} >= 95 THEN 'Chargeback ready' "
            f"WHEN {x} >= 90 THEN 'Chargeback ready (tagged scope)' "
            f"WHEN {x} >= 80 THEN 'Hybrid: chargeback tagged, showback remainder' ELSE 'Showback only' END")


def BASELINE(days: int) -> str:
    return (f"(SELECT CAST(SUM(EffectiveCost) AS DOUBLE) / {days} FROM charges WHERE ChargePeriodStart > "
            f"(SELECT MAX(ChargePeriodStart) FROM charges) - INTERVAL {days} DAY)")


DRIFT = f"100.0 * ({BASELINE(30)} - {BASELINE(90)}) / NULLIF({BASELINE(90)}, 0)"

add("K01_total_spend", f"SELECT {SUM('EffectiveCost')} AS total_spend FROM charges")
add("K02_month_deltas", "SELECT * FROM deltas", MONTHS, DELTAS)
add("K03_latest_deltas", "SELECT mom_pct, yoy_pct FROM deltas ORDER BY period DESC LIMIT 1", MONTHS, DELTAS)
add("K04_burn_rate", f"SELECT {R(BURN, 2)} AS burn_rate FROM charges")
add("K05_run_rate", f"SELECT {R(BURN + ' * 365', 2)} AS run_rate FROM charges")
add("K06_commitment_coverage", f"SELECT {R(COVERAGE)} AS coverage_pct FROM charges")
add("K07_commitment_utilisation", f"SELECT {R(UTIL)} AS utilization_pct FROM charges")
add("K08_commitment_waste", f"""SELECT {_unused} AS commitment_waste,
{R(f"100.0 * {_unused} / NULLIF({SUM('EffectiveCost', HAS)}, 0)")} AS commitment_waste_pct FROM charges""")
add("K09_on_demand_equivalent", f"SELECT {_ul} AS on_demand_equivalent FROM charges")
add("K10_effective_savings_rate", f"SELECT {R(f'100.0 * ({_ul} - {_uc} - 1000) / NULLIF({_ul}, 0)')} AS esr_pct FROM charges")
add("K11_esr_components", f"""SELECT {R(UTIL)} AS utilization_pct, {R(COVERAGE)} AS coverage_pct, {R(DISCOUNT)} AS discount_pct,
{R(IMPLIED)} AS implied_esr_pct FROM charges""")
add("K12_months_observed", f"SELECT {R(MONTHS_OBSERVED)} AS months_observed FROM charges")
_TAGCOV = "100.0 * {a} / NULLIF(" + SUM("EffectiveCost") + ", 0)"
add("K14_allocation_coverage", "\nUNION ALL ".join(
    f"SELECT '{t}' AS tag_key, {R(x)} AS coverage_pct, {R(f'100 - {x}')} AS unallocated_pct FROM charges"
    for t in ("application", "business_unit", "environment")
    for x in [_TAGCOV.format(a=SUM("EffectiveCost", f"tag_{t} <> 'Unallocated'"))]))
add("K15_chargeback_readiness", f"SELECT 'application' AS tag_key, {READY('c')} AS readiness FROM (SELECT {ALLOCATED} AS c FROM charges)")
add("K16_unit_cost", f"SELECT {R(SUM('EffectiveCost') + ' / 3600')} AS unit_cost FROM charges")
add("K17_unit_cost_series", f"""SELECT period, cost, value, {R('cost / NULLIF(value, 0)')} AS unit_cost FROM months JOIN (
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(COUNT(DISTINCT o_orderkey) AS DOUBLE) AS value FROM orders GROUP BY 1) USING (period)""",
    MONTHS)


def VARIANCE(actual: str = "actual", budget: str = "budget", money: int = 6) -> str:
    p = f"(100.0 * ({actual} - {budget}) / NULLIF({budget}, 0))"
    return (f"{R(f'{actual} - {budget}', money)} AS variance_abs, {R(p)} AS variance_pct, "
            f"CASE WHEN {actual} - {budget} > 0 THEN 'Overrun' ELSE 'Underrun' END AS direction, "
            f"CASE WHEN {p} IS NULL THEN 'unknown' WHEN {p} > 10 THEN 'critical' WHEN {p} > 2 THEN 'serious' "
            f"WHEN {p} < -10 THEN 'warning' ELSE 'good' END AS status")


add("K18_variance_rows", f"""SELECT ProviderName, actual, budget, {VARIANCE()} FROM (
SELECT ProviderName, {SUM('EffectiveCost')} AS actual, {SUM('ListCost')} AS budget FROM charges WHERE {USAGE} GROUP BY 1)""")
add("K19_projected_year_end", f"""SELECT ProviderName, ytd, remaining, annual_budget, {R('ytd + remaining')} AS projected_spend,
{R('ytd + remaining - annual_budget')} AS variance_abs, {R('100.0 * (ytd + remaining - annual_budget) / NULLIF(annual_budget, 0)')} AS variance_pct,
CASE WHEN ytd + remaining > annual_budget THEN 'Overrun' ELSE 'Underrun' END AS direction FROM (
SELECT ProviderName, {SUM('EffectiveCost', "ChargePeriodStart >= DATE '2001-01-01' AND ChargePeriodStart < DATE '2001-07-01'")} AS ytd,
{SUM('EffectiveCost', "ChargePeriodStart >= DATE '2001-07-01'")} AS remaining,
{SUM('ListCost', "ChargePeriodStart >= DATE '2001-01-01' AND ProviderName <> 'GCP'")} AS annual_budget FROM charges GROUP BY 1)""")
PAIRS = f"""pairs AS (SELECT * FROM (SELECT ProviderName, cost AS a, LAG(cost) OVER (PARTITION BY ProviderName ORDER BY period) AS f FROM (
SELECT ProviderName, {M} AS period, {COST} FROM charges GROUP BY 1, 2)) WHERE f IS NOT NULL)"""
MAPE = "100.0 * AVG(ABS(a - f) / ABS(a)) FILTER (WHERE a <> 0)"
WAPE = "100.0 * SUM(ABS(a - f)) / NULLIF(SUM(ABS(a)), 0)"
SMAPE = "100.0 * AVG(ABS(a - f) / ((ABS(a) + ABS(f)) / 2)) FILTER (WHERE ABS(a) + ABS(f) <> 0)"
add("K20_accuracy", f"SELECT ProviderName, {R(MAPE)} AS mape, {R(WAPE)} AS wape, {R(SMAPE)} AS smape FROM pairs GROUP BY 1", PAIRS)
add("K21_trailing_baseline", f"SELECT {R(BASELINE(90), 2)} AS baseline")
add("K22_baseline_drift", f"SELECT {R(DRIFT)} AS baseline_drift_pct")
add("K24_commitment_position", f"""SELECT {R(COVERAGE)} AS coverage_pct, {R(UTIL)} AS utilization_pct, {R(ESR)} AS esr_pct,
{R(DISCOUNT)} AS discount_pct, {R(IMPLIED)} AS implied_esr_pct, {R(_unused)} AS commitment_waste_usd,
{R(_ul)} AS on_demand_equivalent_usd FROM charges""")
MATURITY = ("CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} < 5 THEN 'Best-in-class' WHEN {x} < 12 THEN 'Run' "
            "WHEN {x} < 15 THEN 'Walk' WHEN {x} < 20 THEN 'Crawl' ELSE 'Below Crawl' END")
add("K25_maturity_band", f"SELECT ProviderName, {MATURITY.format(x='w')} AS maturity FROM (SELECT ProviderName, {WAPE} AS w FROM pairs GROUP BY 1)", PAIRS)


# --- allocation ---------------------------------------------------------------------------------------
def ALLOC(dim: str, weight: str, where: str = "TRUE") -> str:
    """CTEs: bucketed rows, targets with weight, pools."""
    return f"""bk AS (SELECT *, {dim} AS d, CASE WHEN {dim} IS NULL OR {dim} = 'Unallocated' THEN 'untagged'
  WHEN tag_application = 'Shared Platform Services' OR ServiceCategory IN ('Management and Governance', 'Security') THEN 'shared'
  ELSE 'direct' END AS bucket FROM charges WHERE {where}),
tg0 AS (SELECT d, {D('SUM(EffectiveCost)')} AS direct_cost FROM bk WHERE bucket = 'direct' GROUP BY 1),
drv AS (SELECT d, SUM(ConsumedQuantity) AS q FROM bk GROUP BY 1),
tg AS (SELECT tg0.d, direct_cost, {weight} AS weight FROM tg0 LEFT JOIN drv ON tg0.d = drv.d),
pools AS (SELECT {SUM('EffectiveCost', "bucket = 'shared'")} AS sp, {SUM('EffectiveCost', "bucket = 'untagged'")} AS up FROM bk),
al AS (SELECT d, direct_cost, sp * weight AS shared_cost, up * weight AS untagged_cost,
  direct_cost + sp * weight + up * weight AS total_cost FROM tg, pools)"""


W_EVEN = "1.0 / COUNT(*) OVER ()"
W_PROP = "direct_cost / SUM(direct_cost) OVER ()"
_FIX = "(CASE tg0.d WHEN 'BUILDING' THEN 40.0 WHEN 'MACHINERY' THEN 30.0 WHEN 'FURNITURE' THEN 20.0 ELSE 0.0 END)"
W_FIXED = f"{_FIX} / SUM({_FIX}) OVER ()"
W_DRIVER = "q / SUM(q) OVER ()"
ALLOCATE = """SELECT d AS {dim}, direct_cost, {s} AS shared_cost, {u} AS untagged_cost, {t} AS total_cost,
{p} AS pct_of_total, {h} AS shared_pct FROM al"""


def ALLOCATION(dim: str) -> str:
    return ALLOCATE.format(dim=dim, s=R("shared_cost", 2), u=R("untagged_cost", 2), t=R("total_cost", 2),
                           p=R("100.0 * total_cost / SUM(total_cost) OVER ()"),
                           h=R("CASE WHEN total_cost > 0 THEN 100.0 * shared_cost / total_cost ELSE 0 END"))


BU = "tag_business_unit"
add("L02_row_classification", f"SELECT bucket, COUNT(*) AS rows, {D('SUM(EffectiveCost)')} AS cost FROM bk GROUP BY 1", ALLOC(BU, W_PROP))
add("L03_shared_pool", "SELECT sp AS shared_pool FROM pools", ALLOC(BU, W_PROP))
add("L04_direct_cost", "SELECT d AS tag_business_unit, direct_cost FROM tg", ALLOC(BU, W_PROP))
for _n, _d, _w in (("L05_weights_even", BU, W_EVEN), ("L06_weights_proportional", "ProviderName", W_PROP),
                   ("L07_weights_fixed", BU, W_FIXED), ("L08_weights_driver", BU, W_DRIVER)):
    add(_n, f"SELECT d AS {_d}, {R('CAST(weight AS DOUBLE)')} AS weight FROM tg", ALLOC(_d, _w))
add("L09_allocate", ALLOCATION("tag_application"), ALLOC("tag_application", W_DRIVER))
add("L10_showback", ALLOCATION(BU), ALLOC(BU, W_PROP))
add("L11_chargeback", f"""SELECT '2001-03' AS period, d AS tag_business_unit, 'Direct' AS line_item, {R('direct_cost', 2)} AS amount FROM al
UNION ALL SELECT '2001-03', d, 'Shared allocation', {R('shared_cost', 2)} FROM al
UNION ALL SELECT '2001-03', d, 'Untagged allocation', {R('untagged_cost', 2)} FROM al WHERE untagged_cost > 0""",
    ALLOC(BU, W_FIXED, f"{M} = DATE '2001-03-01'"))


def _gov(tag: str, violations: bool) -> str:
    v = "{} AS violations, " if violations else ""
    if tag in ("cost_center", "owner", "project"):
        return (f"SELECT '{tag}' AS tag_key, 0.0::DOUBLE AS coverage_pct, 0.0::DOUBLE AS unallocated_cost, "
                f"{v.format('CAST(0 AS BIGINT)')}'critical' AS status")
    miss = f"tag_{tag} = 'Unallocated'"
    p = f"100.0 * ({SUM('EffectiveCost')} - {SUM('EffectiveCost', miss)}) / NULLIF({SUM('EffectiveCost')}, 0)"
    return (f"SELECT '{tag}' AS tag_key, {R(p)} AS coverage_pct, {SUM('EffectiveCost', miss)} AS unallocated_cost, "
            f"{v.format(f'COUNT(*) FILTER (WHERE {miss})')}"
            f"CASE WHEN {p} >= 90 THEN 'good' WHEN {p} >= 80 THEN 'warning' ELSE 'critical' END AS status FROM charges")


_TAGS = ["application", "business_unit", "cost_center", "environment", "owner", "project"]
add("L12_coverage_report", "\nUNION ALL ".join(_gov(t, False) for t in _TAGS))
add("L13_untagged_breakdown", f"""SELECT ServiceName, cost, {R('100.0 * cost / SUM(cost) OVER ()')} AS pct_of_untagged FROM (
SELECT ServiceName, {COST} FROM charges WHERE tag_business_unit = 'Unallocated' GROUP BY 1)""")
add("L14_tag_governance", "\nUNION ALL ".join(_gov(t, True) for t in _TAGS))
add("L15_worst_tag", "SELECT MAX(unallocated_cost) AS worst_unallocated FROM (" + "\nUNION ALL ".join(_gov(t, False) for t in _TAGS) + ")")
add("L16_tag_limits", """SELECT ProviderName, 'not_lowercase' AS rule, COUNT(*) AS rows FROM charges
WHERE ProviderName = 'GCP' AND Tags LIKE '{"%' GROUP BY 1""")

# --- budget -----------------------------------------------------------------------------------------------
PLANTED = """planted AS (SELECT * FROM budgets
UNION ALL SELECT period, cloud, 'app-new', budget FROM budgets WHERE application = 'app-1' AND month(period) = 6)"""
add("B01_monthly_actuals", f"SELECT {M} AS period, {D('SUM(EffectiveCost)')} AS actual FROM charges WHERE {USAGE} GROUP BY 1")
add("B02_variance_table", f"""SELECT cloud, application, period, {R('a')} AS actual, {R('b', 2)} AS budget, {VARIANCE('a', 'b', 2)} FROM (
SELECT cloud, application, period, COALESCE(actual, 0) AS a, COALESCE(budget, 0) AS b FROM act FULL JOIN planted USING (cloud, application, period))""",
    BUDGETS, PLANTED)
add("B02b_variance_business_unit", f"""SELECT business_unit, {R('a')} AS actual, {R('b', 2)} AS budget, {VARIANCE('a', 'b', 2)} FROM (
SELECT tag_business_unit AS business_unit, {SUM('EffectiveCost')} AS a, 0.0::DOUBLE AS b FROM charges WHERE {USAGE} GROUP BY 1)""")
BRIDGE = """gap AS (SELECT cloud, SUM(actual) AS a, SUM(budget) AS b FROM act JOIN budgets USING (cloud, application, period) GROUP BY 1),
steps AS (SELECT 0 AS position, 'Budget' AS label, SUM(b) AS delta FROM gap
UNION ALL SELECT row_number() OVER (ORDER BY cloud), cloud, a - b FROM gap)"""
add("B03_bridge", f"""SELECT CAST(position AS BIGINT) AS position, label, {R('delta', 2)} AS delta,
{R('SUM(delta) OVER (ORDER BY position)', 2)} AS level FROM steps
UNION ALL SELECT MAX(position) + 1, 'Forecast', {R('SUM(delta)', 2)}, {R('SUM(delta)', 2)} FROM steps""", BUDGETS, BRIDGE)
LINE = """ln AS (SELECT regr_slope(cost, t) AS b, regr_intercept(cost, t) AS a, COUNT(*) AS n, MAX(period) AS last FROM (
SELECT period, cost, row_number() OVER (ORDER BY period) - 1 AS t FROM months))"""
AHEAD = """ahead AS (SELECT CAST(last + to_months(CAST(s AS INTEGER)) AS DATE) AS period, a + b * (n - 1 + s) AS cost FROM ln,
(SELECT unnest(generate_series(1, 6)) AS s))"""
add("B04_year_end_projection", f"""SELECT {R('y + r', 2)} AS projected_spend, {R('bb', 2)} AS annual_budget, {R('y + r - bb', 2)} AS variance_abs,
{R('100.0 * (y + r - bb) / NULLIF(bb, 0)')} AS variance_pct, CASE WHEN y + r > bb THEN 'Overrun' ELSE 'Underrun' END AS direction,
mr AS months_remaining FROM (SELECT
 (SELECT SUM(actual) FROM act WHERE period >= DATE '2001-04-01') AS y,
 (SELECT SUM(cost) FROM ahead WHERE period < DATE '2002-04-01') AS r,
 (SELECT SUM(budget) FROM budgets WHERE period >= DATE '2001-04-01') AS bb,
 (SELECT COUNT(*) FROM ahead WHERE period < DATE '2002-04-01') AS mr)""", BUDGETS, MONTHS, LINE, AHEAD)
add("B05_burn_down", f"""SELECT period, {R('ca', 2)} AS cumulative_actual, {R('cb', 2)} AS cumulative_budget,
{R('CASE WHEN cb > 0 THEN ca / cb END')} AS pace FROM (
SELECT period, SUM(a) OVER (ORDER BY period) AS ca, SUM(COALESCE(b, 0)) OVER (ORDER BY period) AS cb FROM
 (SELECT period, SUM(actual) AS a FROM act GROUP BY 1) LEFT JOIN
 (SELECT period, SUM(budget) AS b FROM budgets GROUP BY 1) USING (period))""", BUDGETS)
add("B06_run_rate_table", f"""SELECT cloud, {R('m', 2)} AS mtd, {R('m / e', 2)} AS burn_rate_daily, {R('m / e * 365', 2)} AS run_rate_annual FROM (
SELECT ProviderName AS cloud, {D('SUM(EffectiveCost)')} AS m, MAX(MAX(day(ChargePeriodStart))) OVER () AS e FROM charges
WHERE {USAGE} AND {M} = (SELECT MAX({M}) FROM charges WHERE {USAGE}) GROUP BY 1)""")
add("B07_budget_from_history", f"SELECT period, cloud, application, {R('budget', 2)} AS budget FROM budgets", BUDGETS)

# --- anomalies ----------------------------------------------------------------------------------------------
EVENTS = """ev AS (SELECT CAST(ts AS DATE) AS period, event_type AS k, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost FROM events GROUP BY 1, 2)"""


def DETECT(source: str, method: str = "median", threshold: float = 3.5, min_pct: float = 25, min_cost: float = 0) -> str:
    """CTEs ending in `dt`: period, k, cost, expected, residual, score, deviation_pct, is_anomaly, severity."""
    expected = {"median": "quantile_cont(cost, 0.5) OVER (PARTITION BY k ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
                "mad": "median(cost) OVER (PARTITION BY k)", "zscore": "AVG(cost) OVER (PARTITION BY k)"}[method]
    scale = "sd" if method == "zscore" else "CASE WHEN mad > 0 THEN mad ELSE sd END"
    factor = 1.0 if method == "zscore" else 0.6745
    return f"""e1 AS (SELECT period, k, cost, COUNT(*) OVER (PARTITION BY k) AS n, {expected} AS x FROM {source}),
e2 AS (SELECT period, k, cost, n, CASE WHEN n < 10 THEN cost ELSE x END AS expected FROM e1),
e3 AS (SELECT *, cost - expected AS residual, median(cost - expected) OVER (PARTITION BY k) AS mr FROM e2),
e4 AS (SELECT *, median(ABS(residual - mr)) OVER (PARTITION BY k) AS mad,
  COALESCE(NULLIF(stddev_samp(residual) OVER (PARTITION BY k), 0), 1) AS sd FROM e3),
e5 AS (SELECT *, {factor} * residual / ({scale}) AS score,
  CASE WHEN ABS(expected) > 1e-9 THEN residual / expected * 100.0 ELSE 0 END AS deviation_pct FROM e4),
e6 AS (SELECT *, n >= 10 AND ABS(score) > {threshold} AND ABS(deviation_pct) >= {min_pct} AND cost >= {min_cost} AS is_anomaly FROM e5),
dt AS (SELECT *, CASE WHEN NOT is_anomaly THEN 'good' WHEN ABS(deviation_pct) > 100 THEN 'critical'
  WHEN ABS(deviation_pct) > 50 THEN 'serious' WHEN ABS(deviation_pct) > 25 THEN 'warning' ELSE 'good' END AS severity FROM e6)"""


def DAILY(dim: str) -> str:
    return f"""dl AS (SELECT ChargePeriodStart AS period, {dim} AS k, {COST} FROM charges
WHERE date_diff('day', ChargePeriodStart, ChargePeriodEnd) <= 2 GROUP BY 1, 2)"""


FULL = (f"cost, {R('expected')} AS expected, {R('residual')} AS residual, {R('score')} AS score, is_anomaly, severity, "
        f"{R('deviation_pct')} AS deviation_pct")
add("D01_rolling_median", f"SELECT period, k AS event_type, cost, {R('expected')} AS expected FROM dt", EVENTS, DETECT("ev"))
add("D02_stl_substitute", f"SELECT period, k AS ServiceCategory, {R('expected')} AS expected FROM dt",
    DAILY("ServiceCategory"), DETECT("dl"))
add("D03_zscore", f"SELECT period, k AS event_type, {R('expected')} AS expected, {R('score')} AS score FROM dt", EVENTS, DETECT("ev", "zscore"))
add("D04_mad", f"SELECT period, k AS event_type, {R('expected')} AS expected, {R('score')} AS score FROM dt", EVENTS, DETECT("ev", "mad"))
add("D05_dual_test", "SELECT period, k AS event_type, is_anomaly FROM dt", EVENTS, DETECT("ev", threshold=2.5, min_pct=20, min_cost=100))
add("D06_severity", "SELECT k AS event_type, severity, COUNT(*) AS points FROM dt GROUP BY 1, 2", EVENTS, DETECT("ev", threshold=2.0))
add("D07_warm_up", """SELECT k AS event_type, COUNT(*) FILTER (WHERE is_anomaly) AS flagged, COUNT(*) FILTER (WHERE score <> 0) AS scored
FROM dt GROUP BY 1""", EVENTS, "sv AS (SELECT * FROM ev UNION ALL SELECT period, 'short', cost FROM ev WHERE k = 'error' AND day(period) <= 9)", DETECT("sv", threshold=1.0))
add("D08_detect", f"SELECT period, k AS event_type, {FULL.replace('cost,', R('cost') + ' AS cost,', 1)} FROM dt", EVENTS, DETECT("ev"))
_LABEL = "'rolling_median_mad (stl unavailable)' AS method"
add("D09_detect_by_dimension", f"SELECT period, k AS ServiceCategory, {FULL.replace('cost,', R('cost') + ' AS cost,', 1)}, {_LABEL} FROM dt WHERE is_anomaly",
    DAILY("ServiceCategory"), DETECT("dl"))
add("D10_summarise", f"""SELECT period, k AS dimension, {R('cost')} AS value, {R('expected')} AS expected, {R('residual')} AS deviation_abs,
{R('deviation_pct')} AS deviation_pct, {R('score')} AS score, severity, {R('ABS(score)')} AS score_abs FROM dt WHERE is_anomaly""",
    DAILY("ProviderName"), DETECT("dl", threshold=2.5))
add("D11_report", f"""SELECT period, k AS ServiceName, {FULL.replace('cost,', R('cost') + ' AS cost,', 1)}, {_LABEL} FROM dt WHERE is_anomaly""",
    DAILY("ServiceName"), DETECT("dl"))

# --- forecasts ----------------------------------------------------------------------------------------------
HIST = f"""h AS (SELECT *, row_number() OVER (PARTITION BY p, s ORDER BY period) - 1 AS t, COUNT(*) OVER (PARTITION BY p, s) AS n FROM (
SELECT ProviderName AS p, ServiceCategory AS s, {M} AS period, {COST} FROM charges GROUP BY 1, 2, 3)),
ser AS (SELECT p, s, n, MAX(period) AS last, arg_max(cost, t) AS last_cost, regr_slope(cost, t) AS b, regr_intercept(cost, t) AS a FROM h GROUP BY 1, 2, 3),
steps AS (SELECT unnest(generate_series(1, 14)) AS step)"""
RESID = """nvr AS (SELECT p, s, cost - LAG(cost) OVER (PARTITION BY p, s ORDER BY t) AS r FROM h),
snr AS (SELECT x.p, x.s, x.cost - y.cost AS r FROM h x JOIN h y ON x.p = y.p AND x.s = y.s AND x.t = y.t + 12
  UNION ALL SELECT p, s, r FROM nvr JOIN ser USING (p, s) WHERE n < 12),
lnr AS (SELECT h.p, h.s, cost - (a + b * t) AS r FROM h JOIN ser ON h.p = ser.p AND h.s = ser.s),
sig AS (SELECT 'naive' AS model, p, s, stddev_samp(r) AS sigma FROM nvr GROUP BY 2, 3
  UNION ALL SELECT 'seasonal_naive', p, s, stddev_samp(r) FROM snr GROUP BY 2, 3
  UNION ALL SELECT 'linear', p, s, stddev_samp(r) FROM lnr GROUP BY 2, 3
  UNION ALL SELECT 'ensemble', p, s, stddev_samp(r) FROM (SELECT * FROM lnr UNION ALL SELECT * FROM lnr UNION ALL SELECT * FROM snr) GROUP BY 2, 3)"""
FOLDS = """cuts AS (SELECT p, s, n, j, n - 3 * j AS c FROM ser, (SELECT unnest(generate_series(1, 6)) AS j) WHERE n - 3 * j >= 4),
fit AS (SELECT cuts.p, cuts.s, j, c, cuts.n, regr_slope(cost, t) AS b, regr_intercept(cost, t) AS a, arg_max(cost, t) AS nv
  FROM cuts JOIN h ON cuts.p = h.p AND cuts.s = h.s AND h.t < c GROUP BY 1, 2, 3, 4, 5),
pr AS (SELECT fit.p, fit.s, fit.j, fit.n, h.cost AS act, fit.a + fit.b * h.t AS lin, fit.nv, CASE WHEN c < 12 THEN nv ELSE z.cost END AS sn
  FROM fit JOIN h ON fit.p = h.p AND fit.s = h.s AND h.t BETWEEN c AND c + 2
  LEFT JOIN h z ON z.p = h.p AND z.s = h.s AND z.t = h.t - 12),
wt0 AS (SELECT ser.p, ser.s, o, CASE WHEN ser.n - 3 * o >= 7 THEN SUM(ABS(act - lin)) / SUM(ABS(act)) * 100 END AS wl,
  CASE WHEN ser.n - 3 * o >= 7 THEN SUM(ABS(act - sn)) / SUM(ABS(act)) * 100 END AS ws
  FROM ser CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS o) LEFT JOIN pr ON pr.p = ser.p AND pr.s = ser.s AND pr.j BETWEEN o + 1 AND o + 3
  GROUP BY ser.p, ser.s, o, ser.n),
wt AS (SELECT p, s, o, CASE WHEN wl > 0 THEN 1 / wl ELSE 0 END AS vl, CASE WHEN ws > 0 THEN 1 / ws ELSE 0 END AS vs FROM wt0),
bt AS (SELECT pr.p, pr.s, j, act, nv, sn, lin, CASE WHEN 2 * vl + vs > 0 THEN (2 * vl * lin + vs * sn) / (2 * vl + vs) ELSE (2 * lin + sn) / 3 END AS ens
  FROM pr JOIN wt ON pr.p = wt.p AND pr.s = wt.s AND pr.j = wt.o WHERE pr.n >= 7 AND j <= 3),
lg AS (SELECT p, s, j, 'naive' AS method, act AS a, nv AS f FROM bt UNION ALL SELECT p, s, j, 'seasonal_naive', act, sn FROM bt
  UNION ALL SELECT p, s, j, 'linear', act, lin FROM bt UNION ALL SELECT p, s, j, 'ensemble', act, ens FROM bt),
sc AS (SELECT p, s, method, """ + f"{MAPE} AS mape, {WAPE} AS wape, {SMAPE} AS smape" + """, COUNT(DISTINCT j) AS folds FROM lg GROUP BY 1, 2, 3),
cand AS (SELECT p, s, 1 AS rk, method, wape FROM sc WHERE method = 'seasonal_naive' UNION ALL SELECT p, s, 2, method, wape FROM sc WHERE method = 'linear'
  UNION ALL SELECT p, s, 3, 'holt_winters', wape FROM sc WHERE method = 'linear' UNION ALL SELECT p, s, 4, method, wape FROM sc WHERE method = 'ensemble'),
best AS (SELECT ser.p, ser.s, COALESCE(c.method, 'holt_winters') AS method, c.wape AS wape FROM ser LEFT JOIN (
  SELECT * FROM cand WHERE wape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p, s ORDER BY wape, rk) = 1) c ON c.p = ser.p AND c.s = ser.s)"""
POINTS = """pt AS (SELECT ser.p, ser.s, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS period, last_cost AS naive, a + b * (ser.n - 1 + step) AS linear,
  CASE WHEN ser.n < 12 THEN last_cost ELSE z.cost END AS seasonal_naive
  FROM ser CROSS JOIN steps LEFT JOIN h z ON z.p = ser.p AND z.s = ser.s AND z.t = ser.n - 12 + (step - 1) % 12)"""
ENS = """pe AS (SELECT pt.*, CASE WHEN 2 * vl + vs > 0 THEN (2 * vl * linear + vs * seasonal_naive) / (2 * vl + vs)
  ELSE (2 * linear + seasonal_naive) / 3 END AS ensemble FROM pt JOIN wt ON pt.p = wt.p AND pt.s = wt.s AND wt.o = 0)"""
KEYS = "p AS ProviderName, s AS ServiceCategory"
add("F01_prepare", f"SELECT {KEYS}, period, cost FROM h", HIST)
add("F02_future_periods", f"SELECT {KEYS}, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS period FROM ser, steps", HIST)


def _pointq(method: str, model: str, extra: list[str]) -> None:
    digits = 6 if "naive" in model else 2  # naive points are exact sums
    src = "pe" if model == "ensemble" else "pt"
    add(method[0], f"""SELECT {src}.p AS ProviderName, {src}.s AS ServiceCategory, '{method[1]}' AS method, period, step,
{R('COALESCE(sigma, 0)', 2)} AS sigma, {R(model, digits)} AS yhat FROM {src} LEFT JOIN sig ON sig.p = {src}.p AND sig.s = {src}.s AND sig.model = '{model}'""",
        HIST, RESID, POINTS, *extra)


_pointq(("F03_naive", "naive"), "naive", [])
_pointq(("F04_seasonal_naive", "seasonal_naive"), "seasonal_naive", [])
_pointq(("F05_linear", "linear"), "linear", [])
_pointq(("F06_holt_winters_substitute", "holt_winters"), "linear", [])
_pointq(("F07_sarima_substitute", "sarima"), "linear", [])
_pointq(("F08_ensemble", "ensemble"), "ensemble", [FOLDS, ENS])


def BAND(y: str) -> str:
    z80, z95 = (f"{z} * COALESCE(sigma, 0) * SQRT(step)" for z in (1.2815515594, 1.9599639845))
    return f"{y} - {z80} AS l80, {y} + {z80} AS h80, {y} - {z95} AS l95, {y} + {z95} AS h95"


REPAIR = (f"{R('GREATEST(y, 0)', 2)} AS cost, {R('GREATEST(LEAST(l80, y), 0)', 2)} AS lo80, {R('GREATEST(h80, y, 0)', 2)} AS hi80, "
          f"{R('GREATEST(LEAST(l95, l80, y), 0)', 2)} AS lo95, {R('GREATEST(h95, h80, y, 0)', 2)} AS hi95")
add("F09_residual_interval", f"""SELECT {KEYS}, period, {R('l80', 2)} AS lo80, {R('h80', 2)} AS hi80, {R('l95', 2)} AS lo95, {R('h95', 2)} AS hi95 FROM (
SELECT pt.*, {BAND('linear')} FROM pt JOIN sig ON sig.p = pt.p AND sig.s = pt.s AND sig.model = 'linear')""", HIST, RESID, POINTS)
add("F10_band_repair", f"""SELECT {KEYS}, period, {REPAIR.replace('GREATEST(y, 0), 2', 'GREATEST(y, 0), 6', 1)} FROM (SELECT pt.*, seasonal_naive AS y, {BAND('seasonal_naive')}
FROM pt LEFT JOIN sig ON sig.p = pt.p AND sig.s = pt.s AND sig.model = 'seasonal_naive')""", HIST, RESID, POINTS)
add("F11_backtest", f"""SELECT ser.p AS ProviderName, ser.s AS ServiceCategory, m AS method, {R('mape')} AS mape, {R('wape')} AS wape,
{R('smape')} AS smape, COALESCE(folds, 0) AS folds FROM ser CROSS JOIN (SELECT unnest(['naive', 'seasonal_naive', 'linear', 'ensemble']) AS m)
LEFT JOIN sc ON sc.p = ser.p AND sc.s = ser.s AND sc.method = m""", HIST, FOLDS)
add("F12_auto_select", f"SELECT {KEYS}, method, {R('wape')} AS wape FROM best", HIST, FOLDS)
add("F13_forecast_spend", f"""SELECT {KEYS}, method, period, {REPAIR} FROM (SELECT q.*, {BAND('y')} FROM (
SELECT pe.*, best.method, CASE best.method WHEN 'ensemble' THEN ensemble WHEN 'seasonal_naive' THEN seasonal_naive ELSE linear END AS y, sigma
FROM pe JOIN best ON best.p = pe.p AND best.s = pe.s LEFT JOIN sig ON sig.p = pe.p AND sig.s = pe.s AND sig.model =
  CASE best.method WHEN 'holt_winters' THEN 'linear' ELSE best.method END) q)""", HIST, RESID, FOLDS, POINTS, ENS)
add("F13b_forecast_summary", f"""SELECT best.p AS ProviderName, best.s AS ServiceCategory, method, n AS n_history, {R('wape')} AS wape,
{MATURITY.format(x='wape')} AS maturity FROM best JOIN ser ON ser.p = best.p AND ser.s = best.s""", HIST, FOLDS)


def ESTATE(horizon: int) -> str:
    return f"""fc AS (SELECT CAST(last + to_months(CAST(s AS INTEGER)) AS DATE) AS period, GREATEST(a + b * (n - 1 + s), 0) AS cost
FROM ln, (SELECT unnest(generate_series(1, {horizon})) AS s))"""


CLIFF = f"""disc AS (SELECT ProviderName, {D('SUM(ListCost - EffectiveCost)')} / COUNT(DISTINCT {M}) AS lost FROM charges
  WHERE {HAS} AND CommitmentDiscountStatus = 'Used' GROUP BY 1),
ex AS (SELECT CAST({M} + INTERVAL 12 MONTH AS DATE) AS expiry, lost FROM charges JOIN disc USING (ProviderName)
  WHERE ChargeCategory = 'Purchase' AND {HAS} AND lost > 0),
ov AS (SELECT period, cost, cost + COALESCE((SELECT SUM(lost) FROM ex WHERE expiry <= period AND expiry >= (SELECT MIN(period) FROM fc)), 0) AS cw,
  EXISTS (SELECT 1 FROM ex WHERE expiry = period) AS cliff FROM fc)"""
add("F14_commitment_cliff", f"SELECT period, {R('cost', 2)} AS cost, {R('cw', 2)} AS cost_with_cliffs, cliff FROM ov", MONTHS, LINE, ESTATE(24), CLIFF)
add("F15_driver_overlay", f"""SELECT period, {R('cost', 2)} AS cost,
{R("cost * CASE WHEN period >= DATE '2001-12-01' THEN 1.10 ELSE 1.0 END * CASE WHEN period >= DATE '2002-03-01' THEN 0.95 ELSE 1.0 END", 2)} AS cost_adjusted,
CASE WHEN period >= DATE '2002-03-01' THEN 'rollout; -5% from 2002-03' WHEN period >= DATE '2001-12-01' THEN 'rollout' ELSE '' END AS drivers FROM fc""",
    MONTHS, LINE, ESTATE(8))
add("F16_cliff_summary", f"""SELECT string_agg(strftime(period, '%Y-%m'), ',' ORDER BY period) FILTER (WHERE cliff) AS cliff_months,
ROUND(SUM(cw) - SUM(cost), 2) AS extra_usd, ROUND(SUM(cost), 2) AS baseline_forecast_usd, ROUND(SUM(cw), 2) AS with_cliffs_usd FROM ov""",
    MONTHS, LINE, ESTATE(24), CLIFF)

# --- optimisation -----------------------------------------------------------------------------------------
LEVER_ROWS = """lev(lever_id, lever_name, category, effort, risk, time_to_value) AS (VALUES
('R1','AWS Compute Savings Plan','Rate','Low','Low','Days'), ('R5','Azure Reservations','Rate','Low','Medium','Days'),
('R7','GCP Flexible (spend-based) CUD','Rate','Low','Low','Days'), ('R9','Spot / Preemptible / Azure Spot','Rate','Medium','High','Days'),
('R11','Azure Hybrid Benefit','Rate','Low','Low','Hours'), ('R12','BYOL / licence mobility','Rate','Medium','Medium','Weeks'),
('R14','AWS Graviton / ARM','Rate','Medium','Medium','Weeks'), ('R15','Azure Cobalt / Ampere ARM','Rate','Medium','Medium','Weeks'),
('R16','GCP Axion (C4A) / Tau','Rate','Medium','Medium','Weeks'), ('R17','OCI Annual Universal Credits','Rate','Low','Low','Weeks'),
('R18','OCI Ampere A1 (Arm) Compute','Rate','Medium','Medium','Weeks'), ('R20','BYOL to OCI for Oracle Database','Rate','Low','Low','Hours'),
('R21','Commitment utilization & re-shape','Rate','Medium','Low','Weeks'), ('U4','Unattached EBS / managed disks','Usage','Low','Low','Hours'),
('U5','Idle load balancers','Usage','Low','Low','Hours'), ('U6','Unused Elastic / Public IPs','Usage','Low','Low','Hours'),
('U7','Idle NAT gateways','Usage','Low','Low','Hours'), ('U8','Orphaned snapshots / lifecycle','Usage','Low','Low','Hours'),
('U10','Schedule / park non-prod','Usage','Low','Low','Days'), ('U12','S3 Intelligent-Tiering / lifecycle','Usage','Low','Low','Days'),
('U13','Azure Blob Cool / Cold / Archive','Usage','Low','Low','Days'), ('U14','GCS Nearline / Coldline / Archive / Autoclass','Usage','Low','Low','Days'),
('U15','gp2 -> gp3 EBS','Usage','Low','Low','Hours'), ('U17','Previous-generation instance families','Usage','Low','Low','Days'),
('U18','Tag / allocation coverage remediation','Usage','Medium','Low','Weeks'),
('U21','OCI Object Storage Infrequent Access / Archive','Usage','Low','Low','Days'),
('G3','Model routing (small-model-first)','AI/GPU','Medium','Low','Weeks'), ('G4','Prompt / context caching','AI/GPU','Low','Low','Days'),
('G9','Bedrock Provisioned Throughput vs On-Demand','AI/GPU','Medium','Low','Weeks'))"""
LABEL = "string_agg(DISTINCT ProviderName, ', ' ORDER BY ProviderName)"
EC = D("SUM(EffectiveCost)")
NR = "COUNT(DISTINCT ResourceId)"
RUNNING = f"tag_environment IN ('nonprod','dev','test','staging') AND ServiceCategory = 'Compute' AND {USAGE} AND ConsumedQuantity > 0"
#: Half a cent goes up, as in the decimal reading of a double.
CENTS = "CAST(ROUND(CAST(v AS DECIMAL(28,9)), 2) AS DOUBLE)"
OPPS = f"""nm AS (SELECT CAST(COUNT(DISTINCT {M}) AS DOUBLE) AS nm FROM charges),
prof(cloud, crate, clever, spot, arm, tier) AS (VALUES ('AWS', 0.31::DOUBLE, 'R1', 0.72::DOUBLE, 'R14', 'U12'), ('Azure', 0.34, 'R5', 0.68, 'R15', 'U13'),
  ('GCP', 0.28, 'R7', 0.75, 'R16', 'U14'), ('OCI', 0.25, 'R17', 0.50, 'R18', 'U21')),
{LEVER_ROWS},
gap AS (SELECT * FROM charges WHERE {USAGE} AND CommitmentDiscountId IS NULL AND PricingCategory = 'Standard'
  AND ServiceCategory IN ('Compute','Databases','AI and Machine Learning','Analytics')),
gapm AS (SELECT ProviderName, {M} AS m, {D('SUM(ListCost)')} AS l FROM gap GROUP BY 1, 2),
gapf AS (SELECT ProviderName, MIN(l) AS fl FROM (SELECT *, row_number() OVER (PARTITION BY ProviderName ORDER BY m DESC) AS rn FROM gapm) WHERE rn <= 6 GROUP BY 1),
gapn AS (SELECT ProviderName, {NR} AS n FROM gap GROUP BY 1),
onids AS (SELECT DISTINCT ResourceId FROM (SELECT ResourceId, {M} AS m, SUM(ConsumedQuantity) AS q FROM charges WHERE {RUNNING} GROUP BY 1, 2) WHERE q >= 648),
aim AS (SELECT {M} AS m, {EC} AS c FROM charges WHERE ServiceCategory = 'AI and Machine Learning' AND {USAGE} GROUP BY 1),
aig AS (SELECT m, c, c / NULLIF(LAG(c) OVER (ORDER BY m), 0) - 1 AS g, row_number() OVER (ORDER BY m DESC) AS rn, COUNT(*) OVER () AS n FROM aim),
ai AS (SELECT AVG(g) FILTER (WHERE rn <= 6) AS g, MAX(c) FILTER (WHERE rn = 1) AS recent, MAX(n) AS n FROM aig),
ail AS (SELECT {LABEL} AS label FROM charges WHERE ServiceCategory = 'AI and Machine Learning' AND {USAGE}),
raw AS (
SELECT 'O01' AS det, clever AS lever_id, cloud, cloud || ' commitment-eligible usage (uncovered)' AS scope, fl * crate AS v, 0.8::DOUBLE AS confidence, n AS resource_count, NULL::DOUBLE AS spend
  FROM gapf JOIN gapn USING (ProviderName) JOIN prof ON cloud = ProviderName
UNION ALL SELECT 'O02', 'R21', ProviderName, ProviderName || ' unused commitment (reduce / improve utilization)', {EC} / ANY_VALUE(nm), 1.0, 0, {EC}
  FROM charges, nm WHERE {HAS} AND CommitmentDiscountStatus = 'Unused' GROUP BY ProviderName
UNION ALL SELECT 'O03', CASE ResourceType WHEN 'Volume' THEN 'U4' WHEN 'LoadBalancer' THEN 'U5' WHEN 'IpAddress' THEN 'U6' WHEN 'Gateway' THEN 'U7' WHEN 'Snapshot' THEN 'U8' END,
  {LABEL}, 'Idle ' || ResourceType || ' resources', {EC} / ANY_VALUE(nm), 0.9, {NR}, {EC}
  FROM charges, nm WHERE ConsumedQuantity = 0 AND EffectiveCost > 0 AND {USAGE} AND ResourceType IN ('Volume','LoadBalancer','IpAddress','Gateway','Snapshot') GROUP BY ResourceType
UNION ALL SELECT 'O04', 'U15', {LABEL}, 'gp2 EBS volumes', {EC} / ANY_VALUE(nm) * 0.20, 0.8, {NR}, {EC} FROM charges, nm WHERE contains(SkuId, 'gp2') AND ConsumedQuantity > 0 HAVING COUNT(*) > 0
UNION ALL SELECT 'O05', 'U17', {LABEL}, 'Previous-generation compute families', {EC} / ANY_VALUE(nm) * 0.125, 0.7, {NR}, {EC} FROM charges, nm
  WHERE ServiceCategory = 'Compute' AND regexp_matches(SkuId, 'm4\\.|c4\\.|r4\\.|t2\\.|_v2|n1-|VM\\.Standard2\\.') HAVING COUNT(*) > 0
UNION ALL SELECT 'O06', 'U10', {LABEL}, 'Non-prod compute running 24x7', {EC} / ANY_VALUE(nm) * 0.65, 0.7, {NR}, {EC} FROM charges, nm
  WHERE {RUNNING} AND ResourceId IN (SELECT ResourceId FROM onids) HAVING COUNT(*) > 0
UNION ALL SELECT 'O07', 'R9', cloud, cloud || ' non-prod compute (Spot-eligible)', {EC} / ANY_VALUE(nm) * (ANY_VALUE(spot) * 0.40), 0.6, {NR}, {EC} FROM charges JOIN prof ON cloud = ProviderName, nm
  WHERE {RUNNING} AND PricingCategory = 'Standard' GROUP BY cloud
UNION ALL SELECT 'O08', ANY_VALUE(arm), cloud, cloud || ' x86 compute (ARM-migratable)', {EC} / ANY_VALUE(nm) * 0.20 * 0.35, 0.6, {NR}, {EC} FROM charges JOIN prof ON cloud = ProviderName, nm
  WHERE ServiceCategory = 'Compute' AND {USAGE} AND ConsumedQuantity > 0 AND NOT regexp_matches(COALESCE(SkuId, ''), 'm7g|c4a|D4as|Cobalt|Ampere|Axion|\\.A1\\.') GROUP BY cloud
UNION ALL SELECT 'O09', CASE ProviderName WHEN 'Azure' THEN 'R11' WHEN 'OCI' THEN 'R20' ELSE 'R12' END, ProviderName, 'License-included compute',
  {EC} / ANY_VALUE(nm) * CASE ProviderName WHEN 'Azure' THEN 0.36::DOUBLE WHEN 'OCI' THEN 0.40 ELSE 0.30 END, CASE ProviderName WHEN 'Azure' THEN 0.65::DOUBLE WHEN 'OCI' THEN 0.60 ELSE 0.50 END, {NR}, {EC}
  FROM charges, nm WHERE contains(SkuId, 'license-included') AND {USAGE} GROUP BY ProviderName
UNION ALL SELECT 'O10', ANY_VALUE(tier), cloud, cloud || ' prod storage (cold-tier candidate)', {EC} / ANY_VALUE(nm) * 0.25 * 0.35, 0.5, {NR}, {EC} FROM charges JOIN prof ON cloud = ProviderName, nm
  WHERE ServiceCategory = 'Storage' AND tag_environment = 'prod' AND ResourceType IN ('Volume','Object') AND ConsumedQuantity > 0 GROUP BY cloud
UNION ALL SELECT 'O11', lv, label, 'AI/ML spend growing ' || format('{{:.0f}}', g * 100) || '%/mo -- ' || (SELECT lever_name FROM lev WHERE lever_id = lv), recent * rt, 0.45, 0, NULL
  FROM ai, ail, (VALUES ('G3', 0.20::DOUBLE), ('G4', 0.12), ('G9', 0.08)) x(lv, rt) WHERE n >= 3 AND g > 0.15 AND recent > 0 AND (lv <> 'G9' OR contains(label, 'AWS'))
UNION ALL SELECT 'O12', 'U18', {LABEL}, 'Untagged / unallocated spend', 0.0, 0.9, 0, {EC} FROM charges WHERE {USAGE} AND tag_application = 'Unallocated' HAVING SUM(EffectiveCost) <> 0),
opps AS (SELECT det, lever_id, lever_name, category, cloud, scope, {CENTS} AS monthly_savings, ROUND({CENTS} * 12, 2) AS annual_savings, effort, risk,
  time_to_value, confidence, CAST(resource_count AS BIGINT) AS resource_count, spend FROM raw JOIN lev USING (lever_id) WHERE v >= 50 OR det = 'O12')"""
OC = "lever_id, lever_name, category, cloud, scope, monthly_savings, annual_savings, effort, risk, time_to_value, confidence, resource_count"
for _id, _slug in {"O01": "commitment_gap", "O02": "commitment_waste", "O03": "idle", "O04": "gp2_volumes", "O05": "previous_generation",
                   "O06": "nonprod_always_on", "O07": "spot_candidates", "O08": "arm_migration", "O09": "licence_included",
                   "O10": "storage_tiering", "O11": "ai_growth", "O12": "untagged_flag"}.items():
    add(f"{_id}_{_slug}", f"SELECT {OC} FROM opps WHERE det = '{_id}'", OPPS)
add("O13_detect_all", f"SELECT {OC} FROM opps", OPPS)
add("O14_idle_examples", """SELECT ResourceType, COUNT(DISTINCT ResourceId) AS resources, string_agg(DISTINCT ResourceId, ',' ORDER BY ResourceId) AS resource_ids
FROM charges WHERE ConsumedQuantity = 0 AND EffectiveCost > 0 AND ChargeCategory = 'Usage' AND ResourceId IS NOT NULL
  AND ResourceType IN ('Volume', 'LoadBalancer', 'IpAddress', 'Gateway', 'Snapshot') GROUP BY 1""")
add("O14_snapshot_rows", """SELECT DATE '2001-09-30' AS as_of, lever_id, cloud, scope, monthly_savings, annual_savings,
CASE WHEN det NOT IN ('O01', 'O11') THEN ROUND(ROUND(spend, 2), 1) END AS evidence_spend, resource_count FROM opps""", OPPS)
add("O15_filtered", """SELECT COUNT(*) AS count, ROUND(COALESCE(SUM(annual_savings), 0), 2) AS total_annual_savings FROM opps
WHERE lower(category) = 'usage' AND annual_savings >= 400000""", OPPS)
WASTE = "(SELECT COALESCE(SUM(monthly_savings), 0) FROM opps WHERE lever_id IN ('U4','U5','U6','U7','U8','U10'))"
add("S09_latest_snapshot", """SELECT DATE '2001-09-30' AS as_of, lever_id, cloud, scope, monthly_savings, annual_savings FROM opps
WHERE list_has_any(string_split(cloud, ', '), ['AWS', 'OCI'])""", OPPS)
add("S12_replaced_snapshot", f"""SELECT DATE '2001-09-29' AS as_of, COUNT(*) AS rows, {R('SUM(annual_savings)', 2)} AS annual_savings FROM opps
UNION ALL SELECT DATE '2001-09-30', COUNT(*), {R('SUM(annual_savings)', 2)} FROM opps WHERE category = 'Usage'""", OPPS)
add("O16_usage_waste", f"SELECT {R(WASTE, 2)} AS usage_waste_monthly", OPPS)
add("O17_savings_by_category", f"""SELECT category, {R('SUM(monthly_savings)', 2)} AS monthly_savings, {R('SUM(annual_savings)', 2)} AS annual_savings,
COUNT(*) AS opportunities FROM opps GROUP BY 1""", OPPS)
add("O18_roadmap", f"""SELECT wave, lever_id, lever_name AS lever, scope, cloud, monthly_savings, annual_savings, effort, risk, time_to_value, confidence,
{R('SUM(annual_savings) OVER (ORDER BY wave, annual_savings DESC, lever_id, cloud, scope)', 2)} AS cumulative_annual_savings FROM (
SELECT *, CAST(CASE WHEN monthly_savings = 0 OR (effort = 'Low' AND risk = 'Low') THEN 1 WHEN effort <> 'High' THEN 2 ELSE 3 END AS BIGINT) AS wave FROM opps)""", OPPS)
add("O20_esr_uplift", f"""SELECT {R('c', 2)} AS current_esr_pct, {R('p', 2)} AS projected_esr_pct, {R('p - c', 2)} AS uplift_pts, {R('r * 12', 2)} AS rate_savings_annual FROM (
SELECT 100.0 * (l - e) / l AS c, 100.0 * (l - GREATEST(e - r * nm, 0)) / l AS p, r FROM nm, (SELECT {_ul} AS l, {_uc} AS e FROM charges),
(SELECT SUM(monthly_savings) AS r FROM opps WHERE category = 'Rate'))""", OPPS)
add("P15_label_parts", "SELECT DISTINCT trim(unnest(string_split(cloud, ','))) AS cloud FROM opps", OPPS)
COW = f"({_unused} + {WASTE} * {MONTHS_OBSERVED})"
add("K13_cost_of_waste", f"SELECT {R(COW, 2)} AS cost_of_waste, {R(f'100.0 * {COW} / NULLIF({SUM('EffectiveCost')}, 0)')} AS waste_pct FROM charges", OPPS)
add("K23_executive_summary", f"""SELECT {R(SUM('EffectiveCost'), 2)} AS total_spend, (SELECT mom_pct FROM deltas ORDER BY period DESC LIMIT 1) AS mom_pct,
(SELECT yoy_pct FROM deltas ORDER BY period DESC LIMIT 1) AS yoy_pct, {R(BURN + ' * 365', 2)} AS run_rate, {R(ESR)} AS esr_pct, {R(COVERAGE)} AS coverage_pct,
{R(UTIL)} AS utilization_pct, {R(_unused, 2)} AS commitment_waste, {R(COW, 2)} AS cost_of_waste,
{R(f"100.0 * {COW} / NULLIF({SUM('EffectiveCost')}, 0)")} AS waste_pct, {R(ALLOCATED)} AS allocation_coverage_pct, {READY(ALLOCATED)} AS chargeback_readiness,
{R(DRIFT)} AS baseline_drift_pct FROM charges""", MONTHS, DELTAS, OPPS)

# --- payloads: what the documents say, straight from the charges ---------------------------------------

def TOT(listed: str, billed: str, cost: str = "EffectiveCost") -> str:
    return (f"COUNT(*) AS rows, {D(f'SUM({cost})')} AS EffectiveCost, {D(f'SUM({listed})')} AS ListCost, "
            f"{D(f'SUM({billed})')} AS BilledCost")


add("V01_aws_cost_explorer", f"""SELECT CASE WHEN ServiceCategory IN ('Compute','Storage','Databases','Analytics','AI and Machine Learning')
THEN ServiceCategory ELSE 'Other' END AS ServiceCategory, 'EUR' AS BillingCurrency, {M} AS period, {TOT('ListCost', 'ListCost')} FROM charges GROUP BY ALL""")
add("V02_azure_query", f"""SELECT CASE WHEN ServiceCategory IN ('Compute','Storage','Security') THEN ServiceCategory ELSE 'Other' END AS ServiceCategory,
ChargePeriodStart AS day, tag_application AS resource_group, {TOT('EffectiveCost', 'EffectiveCost')} FROM charges GROUP BY ALL""")
add("V03_gcp_detailed", f"""SELECT CASE WHEN ServiceCategory IN ('Compute','Analytics','Networking') THEN ServiceCategory ELSE 'Other' END AS ServiceCategory,
tag_application, COALESCE(RegionId, '') AS RegionId, {TOT('ListCost', 'ListCost')} FROM charges GROUP BY ALL""")
add("V04_cloudability", f"""SELECT ProviderName, ServiceName, COALESCE(RegionId, '') AS RegionId,
{TOT('CASE WHEN charge_key % 2 = 1 THEN ListCost ELSE EffectiveCost END', 'EffectiveCost')} FROM charges GROUP BY ALL""")
add("V05_cloudhealth", f"""SELECT COALESCE(SubAccountId, 'none') AS BillingAccountId, ServiceCategory AS ServiceName, {M} AS period,
{TOT('ListCost', 'ListCost', 'ListCost')} FROM charges WHERE ListCost <> 0 GROUP BY ALL""")
add("V06_finout", f"""SELECT upper(ProviderName) AS ProviderName, ServiceName,
{TOT('CASE WHEN ListCost <> 0 THEN ListCost ELSE EffectiveCost END', 'EffectiveCost')} FROM charges GROUP BY ALL""")
_FLEX = "CASE WHEN charge_key % 2 = 0 THEN ListCost ELSE EffectiveCost END"
add("V07_flexera", f"SELECT upper(ProviderName) AS ProviderName, COALESCE(SubAccountId, '') AS SubAccountId, {TOT(_FLEX, _FLEX)} FROM charges GROUP BY ALL")
add("V08_flat_vendors", f"""SELECT CASE ProviderName WHEN 'AWS' THEN 'Vantage' WHEN 'Azure' THEN 'CloudZero' WHEN 'GCP' THEN 'nOps' WHEN 'OCI' THEN 'Harness'
ELSE 'ServiceNow' END AS InvoiceIssuerName, CASE ProviderName WHEN 'GCP' THEN 'AWS' WHEN 'OCI' THEN '' ELSE upper(ProviderName) END AS ProviderName,
CASE ProviderName WHEN 'Azure' THEN 'Unknown' ELSE ServiceName END AS ServiceName, ServiceName AS ChargeDescription,
CASE ProviderName WHEN 'OCI' THEN DATE '1995-01-01' ELSE {M} END AS period, {TOT('EffectiveCost', 'EffectiveCost')} FROM charges GROUP BY ALL""")
add("V09_kubecost", f"""SELECT CASE WHEN ConsumedQuantity = 0 THEN 'Idle' ELSE 'Namespace' END AS ResourceType,
CASE WHEN ConsumedQuantity = 0 THEN '__idle__' ELSE COALESCE(ResourceId, 'unnamed') END AS ResourceId, ConsumedQuantity = 0 AS idle,
{TOT('EffectiveCost', 'EffectiveCost')} FROM charges GROUP BY ALL""")
add("V10_recommendations", f"""SELECT source, cloud, lever, COUNT(*) AS findings, {D('SUM(EffectiveCost)')} AS monthly FROM (
SELECT EffectiveCost, CASE ProviderName WHEN 'AWS' THEN 'aws_cost_optimization_hub' WHEN 'Azure' THEN 'azure_advisor' WHEN 'GCP' THEN 'gcp_recommender'
 WHEN 'OCI' THEN 'OCI Cloud Advisor' ELSE 'finout' END AS source, CASE ProviderName WHEN 'IBM Cloud' THEN '' ELSE ProviderName END AS cloud,
 CASE WHEN ProviderName = 'GCP' THEN 'idle_resource' WHEN ProviderName = 'IBM Cloud' THEN 'idle'
 WHEN ProviderName = 'Azure' THEN CASE WHEN charge_key % 2 = 1 THEN 'rate_optimization' ELSE 'rightsizing' END
 WHEN charge_key % 2 = 1 THEN 'idle_resource' ELSE 'other' END AS lever
FROM charges WHERE ConsumedQuantity = 0 AND EffectiveCost > 0 AND {USAGE} AND NOT (ProviderName = 'OCI' AND charge_key % 2 = 0)) GROUP BY ALL""")
add("V11_budgets", """SELECT CASE cloud WHEN 'OCI' THEN 'All' ELSE cloud END AS cloud, application,
CASE WHEN cloud IN ('AWS', 'GCP') THEN DATE '2001-09-01' ELSE period END AS period, COUNT(*) AS budgets,
CAST(SUM(CAST(ROUND(budget * 100) AS BIGINT)) AS DOUBLE) / 100 AS budget FROM budgets WHERE cloud <> 'IBM Cloud' GROUP BY ALL""", BUDGETS)

add("V05b_cloudhealth_cubes", f"""SELECT a AS BillingAccountId, s AS ServiceName, m AS period, COUNT(*) AS rows, {D('SUM(x)')} AS EffectiveCost,
{D('SUM(x)')} AS ListCost, {D('SUM(x)')} AS BilledCost FROM (SELECT COALESCE(SubAccountId, 'none') AS a, ServiceCategory AS s, {M} AS m, SUM(ListCost) AS x
FROM charges GROUP BY ProviderName, 1, 2, 3) WHERE x <> 0 GROUP BY ALL""")
add("V10b_vendor_recommendations", f"""SELECT source, cloud, lever, COUNT(*) AS findings, COUNT(DISTINCT COALESCE(ResourceId, '')) AS resources,
{D('SUM(EffectiveCost)')} AS monthly FROM (SELECT ResourceId, EffectiveCost,
CASE charge_key % 7 WHEN 0 THEN 'aws_cost_explorer_rightsizing' WHEN 1 THEN 'cloudability' WHEN 2 THEN 'cloudhealth' WHEN 3 THEN 'harness' WHEN 4 THEN 'nops'
 WHEN 5 THEN 'turbonomic' ELSE 'vantage' END AS source, CASE WHEN charge_key % 7 IN (0, 4) THEN 'AWS' ELSE upper(ProviderName) END AS cloud,
CASE WHEN charge_key % 7 IN (1, 2) OR (charge_key % 2 = 0 AND charge_key % 7 <> 5) THEN 'rightsizing' ELSE
 CASE charge_key % 7 WHEN 0 THEN 'idle_resource' WHEN 3 THEN 'NODE' WHEN 4 THEN 'compute-copilot' WHEN 5 THEN
  CASE WHEN charge_key % 2 = 1 THEN 'suspend' ELSE 'resize' END ELSE 'idle' END END AS lever
FROM charges WHERE ConsumedQuantity = 0 AND EffectiveCost > 0 AND {USAGE}) GROUP BY ALL""")
add("V11b_other_budgets", """SELECT cloud, application, CASE WHEN cloud = 'IBM Cloud' THEN period ELSE DATE '2001-09-01' END AS period, COUNT(*) AS budgets,
CAST(SUM(CAST(ROUND(budget * 100) AS BIGINT)) AS DOUBLE) / 100 AS budget FROM budgets WHERE cloud IN ('Azure', 'OCI', 'IBM Cloud') GROUP BY ALL""", BUDGETS)

# --- the catalogue is data both sides share ---------------------------------------------------------------
_CATALOG = ", ".join("(" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in LEVERS)
add("O19_levers_in_use", "SELECT catalog.*, opportunities FROM catalog JOIN (SELECT lever_id AS id, COUNT(*) AS opportunities FROM opps GROUP BY 1) USING (id)",
    OPPS, f"catalog(id, name, category, clouds, savings_low, savings_high, effort, risk, time_to_value) AS (VALUES {_CATALOG})")
