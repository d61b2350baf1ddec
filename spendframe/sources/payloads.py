"""Landed vendor payloads to charges, recommendations and budgets.

Each function takes payload documents already parsed by Spark's JSON reader (see `SCHEMAS`, or
`read`) and explodes them in place; records become rows without leaving the executors. A row
takes its period from its own date, else from the requested window, so it can be validated.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spendframe.sources import maps

RECORD = "map<string,string>"
SCHEMAS = {
    "aws_cost_explorer": "ResultsByTime array<struct<TimePeriod: struct<Start: string, End: string>, Groups: array<struct<"
                         "Keys: array<string>, Metrics: map<string, struct<Amount: string, Unit: string>>>>>>",
    "azure_query": "properties struct<columns: array<struct<name: string>>, rows: array<array<string>>>",
    "gcp_detailed": "billing_account_id string, service struct<description: string>, sku struct<id: string, description: string>, "
                    "project struct<id: string, name: string>, location struct<region: string>, usage_start_time timestamp_ntz, "
                    "usage_end_time timestamp_ntz, invoice struct<month: string>, currency string, cost double, "
                    "usage struct<amount: double, unit: string>, resource struct<name: string>, "
                    "labels array<struct<key: string, value: string>>, credits array<struct<amount: double>>",
    "cloudhealth": f"dimensions array<map<string, array<{RECORD}>>>, data array<array<array<array<double>>>>",
    "kubecost": "data string",
    "flexera": "values array<struct<dimensions: map<string,string>, metrics: map<string,string>>>",
}


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per payload file, typed by schema instead of by an inference pass."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


# --- record access ---------------------------------------------------------------------------
def first(record: Column, *keys: str, default: Column | str | None = None) -> Column:
    """The first non-empty value among several spellings."""
    values = [F.nullif(F.try_element_at(record, F.lit(k)), F.lit("")) for k in keys]
    return F.coalesce(*values, default if isinstance(default, Column) else F.lit(default).cast("string"))


def _double(value: Column) -> Column:
    return value.try_cast("double")


def number(record: Column, *keys: str, default: Column | float = 0.0) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(_double(first(record, *keys)), fallback)


def records(df: DataFrame, *containers: str) -> DataFrame:
    """One row per record of the first non-empty container."""
    present = [F.when(F.size(c) > 0, F.col(c)) for c in containers]
    return df.select(F.explode(F.coalesce(*present)).alias("r"))


def _date(value: Column) -> Column:
    return value.try_cast("timestamp").cast("timestamp_ntz")


def _map(table: dict[str, str], key: Column, default: str) -> Column:
    """Lookup in a fixed table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def category(services: dict[str, str], name: Column) -> Column:
    return _map(services, F.coalesce(name, F.lit("")), "Other")


def with_periods(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Fill charge and billing period: own date and one day, else the requested window."""
    own = F.col("ChargePeriodStart") if "ChargePeriodStart" in df.columns else F.lit(None).cast("timestamp_ntz")
    until = F.col("ChargePeriodEnd") if "ChargePeriodEnd" in df.columns else F.lit(None).cast("timestamp_ntz")
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    begin = F.coalesce(own, lo)
    finish = F.coalesce(until, F.when(own.isNull(), hi).otherwise(own + F.expr("INTERVAL 1 DAY")))
    out = df.withColumns({"ChargePeriodStart": begin, "ChargePeriodEnd": finish})
    billing = F.trunc(F.col("ChargePeriodStart").cast("date"), "month")
    return out.withColumns({"BillingPeriodStart": billing.cast("timestamp_ntz"),
                            "BillingPeriodEnd": F.add_months(billing, 1).cast("timestamp_ntz")})


def _money(billed: Column, effective: Column, listed: Column, contracted: Column) -> list[Column]:
    return [billed.alias("BilledCost"), effective.alias("EffectiveCost"), listed.alias("ListCost"),
            contracted.alias("ContractedCost")]


def _text(**columns: Column | str) -> list[Column]:
    return [(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in columns.items()]


# --- cloud payloads ---------------------------------------------------------------------------
def aws_cost_explorer(df: DataFrame, start: dt.date, end: dt.date, account: str = "") -> DataFrame:
    """Periods x groups; list cost is the billed cost, as this source has no list price."""
    groups = (df.select(F.explode("ResultsByTime").alias("p"))
              .select("p.TimePeriod", F.explode("p.Groups").alias("g")))

    def metric(name: str, part: str) -> Column:
        return F.try_element_at(F.col("g.Metrics"), F.lit(name))[part]

    def amount(name: str) -> Column:
        return F.coalesce(_double(metric(name, "Amount")), F.lit(0.0))

    service = F.coalesce(F.get("g.Keys", F.lit(0)), F.lit("Unknown"))
    linked = F.coalesce(F.get("g.Keys", F.lit(1)), F.lit(account))
    payer = F.lit(account) if account else linked
    currency = F.coalesce(F.nullif(metric("AmortizedCost", "Unit"), F.lit("")),
                          F.nullif(metric("UnblendedCost", "Unit"), F.lit("")), F.lit("USD"))
    unblended, amortized = amount("UnblendedCost"), amount("AmortizedCost")
    out = groups.select(
        *_text(BillingAccountId=payer, BillingAccountName=F.concat(F.lit("AWS Account "), payer), BillingCurrency=currency,
               InvoiceIssuerName="Amazon Web Services", SubAccountId=linked,
               SubAccountName=F.concat(F.lit("Account "), linked), SubAccountType="Account", ChargeCategory="Usage",
               ChargeDescription=F.concat(service, F.lit(" usage")), ProviderName="AWS",
               PublisherName="Amazon Web Services", ServiceName=service, ServiceCategory=category(maps.AWS_SERVICES, service)),
        _date(F.col("TimePeriod.Start")).alias("ChargePeriodStart"), _date(F.col("TimePeriod.End")).alias("ChargePeriodEnd"),
        *_money(unblended, amortized, unblended, amortized),
        amount("UsageQuantity").alias("PricingQuantity"), amount("UsageQuantity").alias("ConsumedQuantity"))
    return with_periods(out, start, end)


def azure_query(df: DataFrame, start: dt.date, end: dt.date, subscription: str = "", daily: bool = True) -> DataFrame:
    """A column-name list with row arrays; the date may be a yyyyMMdd number.

    A row with fewer cells than names has nulls in the last ones; cells beyond the names are dropped.
    """
    names = F.transform("properties.columns", lambda c: c["name"])
    cells = F.transform("names", lambda _, i: F.try_element_at("row", i + 1))
    rows = df.select(names.alias("names"), F.explode("properties.rows").alias("row")).select(F.map_from_arrays("names", cells).alias("r"))
    r = F.col("r")
    service, group = first(r, "ServiceName"), first(r, "ResourceGroup", default="")
    raw = first(r, "UsageDate", "BillingMonth")
    own = F.when(raw.rlike(r"^\d{8}$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd")).cast("timestamp_ntz")).otherwise(_date(raw))
    cost = number(r, "Cost", "PreTaxCost")
    until = own + F.expr("INTERVAL 1 DAY") if daily else own + F.expr("INTERVAL 1 MONTH")
    out = rows.select(
        *_text(BillingAccountId=subscription or "unknown",
               BillingAccountName=f"Azure Subscription {subscription}" if subscription else "Azure Billing Account",
               BillingCurrency=first(r, "Currency", "BillingCurrency", default="USD"), InvoiceIssuerName="Microsoft",
               SubAccountId=subscription, SubAccountName=f"Subscription {subscription}" if subscription else "",
               SubAccountType="Subscription", ChargeCategory="Usage",
               ChargeDescription=F.trim(F.concat(F.coalesce(service, F.lit("Azure")), F.lit(" usage in "), group)),
               ProviderName="Azure", PublisherName="Microsoft", ServiceName=F.coalesce(service, F.lit("Azure")),
               ServiceCategory=category(maps.AZURE_SERVICES, service)),
        own.alias("ChargePeriodStart"), until.alias("ChargePeriodEnd"), *_money(cost, cost, cost, cost),
        F.when(group != "", F.create_map(F.lit("resource_group"), group))
        .otherwise(F.create_map().cast(RECORD)).alias("Tags"))
    return with_periods(out, start, end)


def gcp_detailed(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Detailed export rows: negative credits are added to the effective cost."""
    credit = F.aggregate(F.coalesce("credits", F.array().cast("array<struct<amount:double>>")), F.lit(0.0),
                         lambda a, c: a + F.coalesce(c["amount"], F.lit(0.0)))
    cost = F.coalesce("cost", F.lit(0.0))
    name, blank = F.col("service.description"), F.lit("")
    account = F.nullif("billing_account_id", blank)
    quantity = F.coalesce("usage.amount", F.lit(0.0))
    begin = F.col("usage_start_time")
    # Of labels sharing a key the last counts.
    labels = F.coalesce("labels", F.array().cast("array<struct<key:string,value:string>>"))
    last = F.filter(labels, lambda e, i: ~F.exists(F.slice(labels, i + 2, F.size(labels)), lambda o: o["key"] == e["key"]))
    out = df.select(
        *_text(BillingAccountId=F.coalesce(account, F.lit("unknown")),
               BillingAccountName=F.coalesce(account, F.lit("GCP Billing Account")),
               BillingCurrency=F.coalesce(F.nullif("currency", blank), F.lit("USD")), InvoiceIssuerName="Google Cloud",
               InvoiceId=F.coalesce("invoice.month", blank), SubAccountId=F.coalesce("project.id", blank),
               SubAccountName=F.coalesce("project.name", blank), SubAccountType="Project", ChargeCategory="Usage",
               ChargeDescription=F.coalesce(F.nullif("sku.description", blank), F.concat(name, F.lit(" usage"))),
               ConsumedUnit=F.coalesce("usage.unit", blank), PricingUnit=F.coalesce("usage.unit", blank),
               ProviderName="GCP", PublisherName="Google Cloud", ServiceName=F.coalesce(name, F.lit("Google Cloud")),
               ServiceCategory=category(maps.GCP_SERVICES, name), RegionId=F.coalesce("location.region", blank),
               SkuId=F.coalesce("sku.id", blank), ResourceName=F.coalesce("resource.name", blank)),
        begin.alias("ChargePeriodStart"), F.col("usage_end_time").alias("ChargePeriodEnd"),
        *_money(cost, cost + credit, cost, cost + credit), quantity.alias("ConsumedQuantity"), quantity.alias("PricingQuantity"),
        F.map_from_entries(last).alias("Tags"))
    return with_periods(out, start, end)


def cloudhealth(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A (time, account, service) cube with its member lists; empty and zero cells are dropped."""
    def members(name: str, missing: str) -> Column:
        found = F.try_element_at(F.filter("dimensions", lambda d: F.map_contains_key(d, name)), F.lit(1))
        single = F.array(F.create_map(F.lit("label"), F.lit(missing)))
        listed = F.try_element_at(found, F.lit(name))
        return F.when(F.size(listed) > 0, listed).otherwise(single)

    cells = df.select(members("time", "").alias("t"), members("AWS-Account", "").alias("a"),
                      members("AWS-Service-Category", "Unknown").alias("s"), F.posexplode("data").alias("ti", "d1"))
    cells = cells.select("t", "a", "s", "ti", F.posexplode("d1").alias("ai", "d2"))
    cells = cells.select("t", "a", "s", "ti", "ai", F.posexplode("d2").alias("si", "d3"))
    cells = cells.filter((F.get("d3", F.lit(0)) != 0) & (F.col("ti") < F.size("t")) & (F.col("ai") < F.size("a"))
                         & (F.col("si") < F.size("s")))
    period = first(F.get("t", F.col("ti")), "name", "label", default="")
    account = first(F.get("a", F.col("ai")), "label", "name", default="")
    service = first(F.get("s", F.col("si")), "label", "name", default="Unknown")
    cost = F.get("d3", F.lit(0))
    # Months come as yyyy-MM (or a date); totals and other labels take the window.
    begin = _date(F.when(period.rlike(r"^\d{4}-\d{2}$"), F.concat(period, F.lit("-01"))).otherwise(period))
    out = cells.select(
        *_text(BillingAccountId=account, BillingAccountName=account, BillingCurrency="USD", InvoiceIssuerName="CloudHealth",
               ProviderName="AWS", ChargeCategory="Usage",
               ChargeDescription=F.concat(service, F.lit(" ("), period, F.lit(")")), ServiceCategory="Other",
               ServiceName=service),
        begin.alias("ChargePeriodStart"), (begin + F.expr("INTERVAL 1 MONTH")).alias("ChargePeriodEnd"),
        *_money(cost, cost, cost, cost))
    return with_periods(out, start, end)


def kubecost(df: DataFrame, start: dt.date, end: dt.date, cluster: str = "Kubecost") -> DataFrame:
    """Allocations by name, as a list of objects or one object; idle entries consume nothing."""
    block = "map<string,map<string,string>>"
    blocks = F.when(F.col("data").startswith("["), F.from_json("data", f"array<{block}>")).otherwise(
        F.array(F.from_json("data", block)))
    rows = df.select(F.explode(blocks).alias("b")).select(F.explode("b").alias("name", "r")).filter("r is not null")
    name, r = F.col("name"), F.col("r")
    idle = name.isin("__idle__", "__unmounted__") | (F.lower(name) == "idle")
    cost = number(r, "totalCost")
    out = rows.select(
        *_text(BillingAccountId=cluster, BillingAccountName=cluster, BillingCurrency="USD", InvoiceIssuerName="Kubernetes",
               ProviderName="Kubernetes", ChargeCategory="Usage",
               ChargeDescription=F.when(idle, "Kubernetes idle capacity").otherwise(
                   F.concat(F.lit("Kubernetes allocation: "), name)),
               ServiceCategory="Compute", ServiceSubcategory="Containers", ServiceName="Kubernetes",
               ResourceType=F.when(idle, "Idle").otherwise("Namespace"), ResourceId=name, ResourceName=name),
        *_money(cost, cost, cost, cost),
        F.when(idle, 0.0).otherwise(number(r, "totalEfficiency")).alias("ConsumedQuantity"),
        F.when(idle, F.create_map().cast(RECORD)).otherwise(F.create_map(F.lit("namespace"), name)).alias("Tags"))
    return with_periods(out, start, end)


# --- flat vendor records: one mapping table ------------------------------------------------------
@dataclass(frozen=True)
class Flat:
    """Where a vendor keeps what. Empty `billed`/`listed` fall back to the column before."""

    containers: tuple[str, ...]
    issuer: str
    effective: tuple[str, ...]
    billed: tuple[str, ...] = ()
    listed: tuple[str, ...] = ()
    provider: tuple[str, ...] = ()
    fixed_provider: str = ""
    upper: bool = True
    account: tuple[str, ...] = ()
    account_default: str = ""
    account_name: tuple[str, ...] = ()
    account_name_default: str = ""
    currency: tuple[str, ...] = ()
    date: tuple[str, ...] = ()
    description: tuple[str, ...] = ("service",)
    service: tuple[str, ...] = ("service",)
    default_description: str = "Cloud usage"
    quantity: tuple[str, ...] = ()
    extra: dict[str, tuple[str, ...]] = field(default_factory=dict)


# --- fixed values: the field names of vendors with flat rows ---
FLAT = {
    "cloudability": Flat(
        ("results",), "Cloudability", ("amortized_cost", "amortizedCost"), ("unblended_cost", "unblendedCost"),
        ("list_cost", "listCost"), ("vendor",), upper=False, account=("vendor_account_identifier",),
        account_name=("vendor_account_name",), description=("usage_family", "service_name"), service=("service_name",),
        quantity=("usage_quantity",),
        extra={"SubAccountId": ("vendor_account_identifier",), "SubAccountName": ("vendor_account_name",),
               "RegionId": ("region",), "ResourceId": ("resource_identifier",)}),
    "flexera": Flat(
        ("values",), "Flexera", ("cost_amortized_unblended_adj",), ("cost_nonamortized_unblended_adj",), (), ("vendor",),
        account=("vendor_account",), account_name=("vendor_account",), description=("service", "category"),
        quantity=("usage_amount",), extra={"SubAccountId": ("vendor_account",), "ConsumedUnit": ("usage_unit",)}),
    "vantage": Flat(
        ("costs",), "Vantage", ("amount", "cost"), provider=("provider",), account=("account_id",),
        account_default="vantage", account_name_default="Vantage", date=("accrued_at", "date"),
        description=("service", "category")),
    "cloudzero": Flat(
        ("costs", "data"), "CloudZero", ("cost", "real_cost", "amount"), provider=("cloud_provider", "provider"),
        account=("account_id", "billing_account"), account_default="cloudzero", account_name=("account_name",),
        account_name_default="CloudZero", date=("date", "usage_date"), description=("service", "element")),
    "nops": Flat(
        ("results", "data"), "nOps", ("cost", "amount", "total"), fixed_provider="AWS", account=("account_id",),
        account_default="nops", account_name=("account_name",), account_name_default="nOps", date=("date", "period")),
    "harness": Flat(
        ("gridData",), "Harness", ("cost", "value"), account_default="harness", account_name_default="Harness CCM",
        description=("name", "id"), service=("name", "id"), default_description="Unknown"),
    "servicenow": Flat(
        ("result",), "ServiceNow", ("cost", "amount", "u_cost", "total_cost"),
        provider=("cloud_provider", "u_cloud_provider", "provider"), account=("account", "u_account_id", "account_id"),
        account_default="servicenow", account_name=("account_name", "u_account_name"),
        account_name_default="ServiceNow CCM", currency=("currency",), date=("usage_date", "u_date", "date"),
        description=("service", "u_service", "short_description"), service=("service", "u_service")),
}


def flat_schema(vendor: str) -> str:
    return ", ".join(f"{c} array<{RECORD}>" for c in FLAT[vendor].containers)


def flat_costs(df: DataFrame, vendor: str, start: dt.date, end: dt.date) -> DataFrame:
    """Documents of one flat vendor to charges."""
    rows = flexera_records(df) if vendor == "flexera" else records(df, *FLAT[vendor].containers)
    return flat_records(rows, FLAT[vendor], start, end)


def flexera_records(df: DataFrame) -> DataFrame:
    """Dimensions and metrics as one record."""
    return records(df, "values").select(F.map_concat("r.dimensions", "r.metrics").alias("r"))


def flat_records(rows: DataFrame, spec: Flat, start: dt.date, end: dt.date) -> DataFrame:
    r = F.col("r")
    effective = number(r, *spec.effective)
    billed = number(r, *spec.billed, default=effective) if spec.billed else effective
    listed = number(r, *spec.listed, default=billed) if spec.listed else billed
    provider = F.lit(spec.fixed_provider) if not spec.provider else first(r, *spec.provider, default="")
    provider = F.upper(provider) if spec.upper else provider
    named = F.nullif(provider, F.lit(""))
    # A record without an account name carries the provider's name when the vendor's default is its own.
    vantage = spec.issuer == "Vantage"
    account = first(r, *spec.account, default=F.coalesce(named, F.lit(spec.account_default)) if vantage else spec.account_default)
    account_name = F.coalesce(named, F.lit(spec.account_name_default)) if vantage else \
        first(r, *spec.account_name, default=spec.account_name_default)
    issuer = F.coalesce(named, F.lit(spec.issuer)) if spec.issuer == "Cloudability" else F.lit(spec.issuer)
    out = rows.select(
        *_text(BillingAccountId=account, BillingAccountName=account_name,
               BillingCurrency=first(r, *spec.currency, default="USD"), InvoiceIssuerName=issuer, ProviderName=provider,
               ChargeCategory="Usage", ChargeDescription=first(r, *spec.description, default=spec.default_description),
               ServiceCategory="Other", ServiceName=first(r, *spec.service, default="Unknown"),
               **{n: first(r, *keys, default="") for n, keys in spec.extra.items()}),
        *_money(billed, effective, listed, effective if spec.billed else billed),
        *([number(r, *spec.quantity).alias("ConsumedQuantity")] if spec.quantity else []),
        *([_date(first(r, *spec.date)).alias("ChargePeriodStart")] if spec.date else []))
    return with_periods(out, start, end)


def finout(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Measures are cells `<measure>_sum` holding an amount, or the bare number; 0 falls back."""
    rows, r = records(df, "data"), F.col("r")

    def measure(name: str) -> Column:
        cell = F.try_element_at(r, F.lit(f"{name}_sum"))
        return F.coalesce(_double(F.get_json_object(cell, "$.amount")), _double(cell), F.lit(0.0))

    def non_zero(value: Column, fallback: Column) -> Column:
        return F.when(value != 0, value).otherwise(fallback)

    # Cells are parsed below the projection that compares and falls back on them, so once each.
    read = rows.select(
        F.upper(first(r, "_billing_dimension_provider", default="")).alias("provider"),
        first(r, "_billing_dimension_service", default="Unknown").alias("service"),
        *[measure(name).alias(name) for name in ("amortizedCost", "unblendedCost", "listCost", "usageAmount")])
    named = F.nullif("provider", F.lit(""))
    billed = non_zero(F.col("unblendedCost"), F.col("amortizedCost"))
    out = read.select(
        *_text(BillingAccountId=F.coalesce(named, F.lit("finout")), BillingAccountName=F.coalesce(named, F.lit("Finout")),
               BillingCurrency="USD", InvoiceIssuerName="Finout", ProviderName=F.col("provider"), ChargeCategory="Usage",
               ChargeDescription=F.col("service"), ServiceCategory="Other", ServiceName=F.col("service")),
        *_money(billed, F.col("amortizedCost"), non_zero(F.col("listCost"), billed), F.col("amortizedCost")),
        F.col("usageAmount").alias("ConsumedQuantity"))
    return with_periods(out, start, end)


# --- recommendations ------------------------------------------------------------------------------
def _finding(source: str, cloud: Column | str, resource: Column | str, kind: Column | str, lever: Column | str,
             action: Column | str, savings: Column, currency: Column | str = "USD", risk: Column | str = "Medium",
             confidence: float = 0.7, account: Column | str = "", region: Column | str = "",
             detail: dict[str, Column] | None = None) -> list[Column]:
    pairs = [x for k, v in (detail or {}).items() for x in (F.lit(k), v.cast("string"))]
    entries = F.create_map(*pairs) if pairs else F.create_map().cast(RECORD)
    return [*_text(source=source, cloud=cloud, resource_id=resource, resource_type=kind, lever=lever, action=action),
            savings.alias("estimated_monthly_savings"), *_text(currency=currency, effort="Medium", risk=risk),
            F.lit(confidence).alias("confidence"), *_text(account_id=account, region=region), entries.alias("detail")]


def aws_hub(df: DataFrame) -> DataFrame:
    rows, r = records(df, "items"), F.col("r")
    action = first(r, "actionType", default="")
    return rows.select(*_finding(
        "aws_cost_optimization_hub", "AWS", first(r, "resourceId", "recommendationId", default=""),
        first(r, "currentResourceType", default=""), _map(maps.AWS_ACTIONS, action, "other"),
        first(r, "actionType", default="Optimize"), number(r, "estimatedMonthlySavings"),
        first(r, "currencyCode", default="USD"), confidence=0.8, account=first(r, "accountId", default=""),
        region=first(r, "region", default=""),
        detail={k: F.try_element_at(r, F.lit(k)) for k in
                ("recommendationId", "recommendedResourceType", "estimatedSavingsPercentage")}))


def aws_rightsizing(df: DataFrame) -> DataFrame:
    """Terminate findings are idle resources; modify findings take their best target."""
    rows = df.select(F.explode("RightsizingRecommendations").alias("r"))
    stop = F.col("r.RightsizingType") == "TERMINATE"
    targets = F.transform(F.coalesce("r.ModifyRecommendationDetail.TargetInstances",
                                     F.array().cast("array<struct<EstimatedMonthlySavings:string>>")),
                          lambda t: F.coalesce(t["EstimatedMonthlySavings"].try_cast("double"), F.lit(0.0)))
    savings = F.when(stop, _double(F.col("r.TerminateRecommendationDetail.EstimatedMonthlySavings"))).otherwise(F.array_max(targets))
    return rows.select(*_finding(
        "aws_cost_explorer_rightsizing", "AWS", F.coalesce("r.CurrentInstance.ResourceId", F.lit("")), "Amazon EC2 instance",
        F.when(stop, "idle_resource").otherwise("rightsizing"), F.when(stop, "Terminate").otherwise("Modify"),
        F.coalesce(savings, F.lit(0.0)), account=F.coalesce("r.AccountId", F.lit(""))))


def azure_advisor(df: DataFrame) -> DataFrame:
    """Monthly savings, else a twelfth of the annual; reservations are rate findings."""
    p = "r.properties"
    rows = df.select(F.explode("value").alias("r"))
    ext = F.col(f"{p}.extendedProperties")
    monthly, annual = number(ext, "savingsAmount"), number(ext, "annualSavingsAmount")
    short = F.col(f"{p}.shortDescription")
    rate = F.exists(F.map_values(short), lambda v: F.lower(v).contains("reserv"))
    return rows.select(*_finding(
        "azure_advisor", "Azure", F.coalesce(F.col(f"{p}.resourceMetadata.resourceId"), F.lit("")),
        F.coalesce(F.col(f"{p}.impactedField"), F.lit("")), F.when(rate, "rate_optimization").otherwise("rightsizing"),
        first(short, "solution", default="Optimize"), F.when(monthly != 0, monthly).otherwise(annual / 12.0),
        first(ext, "savingsCurrency", default="USD"), F.coalesce(F.col(f"{p}.impact"), F.lit("Medium")), 0.75,
        detail={"category": F.coalesce(F.col(f"{p}.category"), F.lit("Cost"))}))


def gcp_recommender(df: DataFrame) -> DataFrame:
    """Projected cost is negative for a saving: its size counts, units and nanos together."""
    rows = df.select("recommender", F.explode("recommendations").alias("r"))
    cost = F.col("r.primaryImpact.costProjection.cost")
    amount = F.abs(number(cost, "units") + number(cost, "nanos") / 1e9)
    return rows.select(*_finding(
        "gcp_recommender", "GCP", F.coalesce("r.name", F.lit("")), F.element_at(F.split("recommender", r"\."), -1),
        _map(maps.GCP_RECOMMENDERS, F.col("recommender"), "other"), F.coalesce("r.recommenderSubtype", F.lit("Optimize")),
        amount, first(cost, "currencyCode", default="USD"), F.coalesce("r.priority", F.lit("P3")), 0.75,
        detail={"state": F.coalesce("r.stateInfo.state", F.lit("")), "recommender": F.col("recommender")}))


def oci_advisor(df: DataFrame, tenancy: str = "") -> DataFrame:
    """Tenancy-level findings with a positive saving."""
    rows, r = records(df, "items"), F.col("r")
    name = first(r, "name", default="")
    found = rows.filter(number(r, "estimated_cost_saving") > 0)
    return found.select(*_finding(
        "OCI Cloud Advisor", "OCI", "", first(r, "category_id", default=""), _map(maps.OCI_ADVISOR, name, "other"),
        first(r, "description", "name", default=""), number(r, "estimated_cost_saving"), confidence=0.8, account=tenancy,
        detail={"recommendation": name, "importance": first(r, "importance", default=""), "status": first(r, "status", default="")}))


def cloudability_rightsizing(df: DataFrame) -> DataFrame:
    """`vendor` and `service` of the request, and each item's first recommendation."""
    listed = F.when(F.size("result") > 0, F.col("result")).otherwise(F.col("results"))
    rows = df.select("vendor", "service", F.explode(listed).alias("i"))
    best = F.coalesce(F.get("i.recommendations", F.lit(0)), F.create_map().cast(RECORD))
    return rows.select(*_finding(
        "cloudability", F.upper("vendor"), F.coalesce("i.resourceIdentifier", "i.resourceId", F.lit("")), F.col("service"),
        "rightsizing", first(best, "action", "name", default="Rightsize"), number(best, "savings"),
        detail={"service": F.col("service"), "vendor": F.col("vendor")}))


@dataclass(frozen=True)
class FlatFinding:
    """Key spellings of a vendor whose findings are flat records. `fixed` wins over keys."""

    containers: tuple[str, ...]
    cloud: tuple[str, ...]
    resource: tuple[str, ...]
    kind: tuple[str, ...]
    savings: tuple[str, ...]
    lever: tuple[str, ...] = ()
    action: tuple[str, ...] = ()
    lever_default: str = "rightsizing"
    action_default: str = "Optimize"
    fixed_cloud: str = ""
    per_year: bool = False


# --- fixed values: the field names of flat recommendations ---
FLAT_FINDINGS = {
    "cloudhealth": FlatFinding(("nodes",), ("cloud",), ("resourceId",), ("resourceType",), ("estimatedMonthlySavings",),
                               action=("recommendedAction",), action_default="Rightsize"),
    "finout": FlatFinding(("data",), (), ("resourceId",), ("scan_type",), ("groupYearlyPotentialSavings",), ("scan_type",),
                          action_default="CostGuard recommendation", per_year=True),
    "harness": FlatFinding(("items",), ("cloudProvider",), ("resourceName", "id"), ("resourceType",),
                           ("monthlySaving", "monthlySavings"), ("recommendationType",),
                           action_default="Harness CCM recommendation"),
    "nops": FlatFinding(("results", "data"), (), ("resource_id", "instance_id"), ("resource_type",),
                        ("monthly_savings", "savings"), ("lever",), ("action", "recommendation"), fixed_cloud="AWS"),
    "vantage": FlatFinding(("recommendations",), ("provider",), ("resource_id", "token"), ("category",),
                           ("potential_savings", "savings"), ("category",), ("title", "description")),
}


def flat_findings(df: DataFrame, vendor: str) -> DataFrame:
    spec, r = FLAT_FINDINGS[vendor], F.col("r")
    cloud = F.upper(first(r, *spec.cloud, default="")) if spec.cloud else F.lit(spec.fixed_cloud)
    savings = number(r, *spec.savings)
    return records(df, *spec.containers).select(*_finding(
        vendor, cloud, first(r, *spec.resource, default=""), first(r, *spec.kind, default=spec.lever_default if vendor == "finout" else ""),
        first(r, *spec.lever, default=spec.lever_default) if spec.lever else F.lit(spec.lever_default),
        first(r, *spec.action, default=spec.action_default) if spec.action else F.lit(spec.action_default),
        savings / 12.0 if spec.per_year else savings))


def turbonomic(df: DataFrame) -> DataFrame:
    """Market actions: `target` and `currentEntity` are records, the risk carries a severity."""
    target, current = F.col("target"), F.col("currentEntity")
    action = F.nullif("actionType", F.lit(""))
    return df.select(*_finding(
        "turbonomic", F.upper(first(target, "environmentType", default="")), first(target, "uuid", "displayName", default=""),
        first(current, "className", default=first(target, "className", default="")),
        F.lower(F.coalesce(action, F.lit("RESIZE"))), F.coalesce(F.nullif("details", F.lit("")), action, F.lit("Optimize")),
        F.coalesce(_double(F.col("savingsAmount")), F.lit(0.0)),
        risk=F.initcap(F.coalesce(F.nullif("risk.severity", F.lit("")), F.lit("Medium"))),
        detail={"action_type": F.coalesce(action, F.lit(""))}))


# --- budgets -------------------------------------------------------------------------------------------
def _budget(period: Column, cloud: Column | str, application: Column, amount: Column) -> list[Column]:
    return [F.trunc(period.try_cast("date"), "month").alias("period"), *_text(cloud=cloud, application=application),
            amount.alias("budget")]


# --- fixed values: where clouds' budget documents hold what ---
#: Cloud -> container, name key, key of the nested amount, its path(s): a number, or units and nanos.
CLOUD_BUDGETS = {
    "AWS": ("Budgets", "BudgetName", "BudgetLimit", ("$.Amount",)),
    "Azure": ("value", "name", "properties", ("$.amount",)),
    "GCP": ("budgets", "displayName", "amount", ("$.specifiedAmount.units", "$.specifiedAmount.nanos")),
    "OCI": ("items", "display_name", "amount", ("$",)),
}


def cloud_budgets(df: DataFrame, cloud: str, today: dt.date) -> DataFrame:
    """Budgets of a cloud's own service, dated to the current month.

    Nested amounts arrive as JSON text inside the record.
    """
    container, name, holder, paths = CLOUD_BUDGETS[cloud]
    r = F.col("r")
    parts = [F.coalesce(_double(F.get_json_object(F.try_element_at(r, F.lit(holder)), p)), F.lit(0.0)) for p in paths]
    amount = parts[0] if len(parts) == 1 else parts[0] + parts[1] / 1e9
    label = first(r, name, default="Unallocated" if cloud == "OCI" else "")
    return records(df, container).select(*_budget(F.lit(today), cloud, label, amount))


# --- fixed values: the field names of flat budgets ---
FLAT_BUDGETS = {
    "cloudability": (("result", "results"), ("startDate", "start_date"), ("vendor",), ("amount", "budgetAmount")),
    "flexera": (("values", "budgets"), ("start_at", "period"), ("vendor",), ("amount", "budget")),
    "harness": (("data", "resource"), ("startTime", "period"), (), ("budgetAmount", "amount")),
}


def flat_budgets(df: DataFrame, vendor: str) -> DataFrame:
    containers, dates, clouds, amounts = FLAT_BUDGETS[vendor]
    r = F.col("r")
    cloud = first(r, *clouds, default="All") if clouds else F.lit("All")
    return records(df, *containers).select(*_budget(first(r, *dates), cloud, first(r, "name", default="Budget"), number(r, *amounts)))


def union(frames: list[DataFrame]) -> DataFrame:
    """Frames of one shape from several sources."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
