"""Payload mappings as queries: Spark writes vendor documents from the charges, one per row, and
the mapping reads them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from spendframe.functions.columns import COST, LIST
from spendframe.operators import budget as bu, normalize as nz
from spendframe.plans.queries import on_charges
from spendframe.sources import payloads as pl

START, END = dt.date(1995, 1, 1), dt.date(2002, 1, 1)
TODAY = dt.date(2001, 9, 30)


def documents(df: DataFrame, schema: str, *keep: str, **fields: Column) -> DataFrame:
    """Rows as JSON text, parsed again the way a landed file is.

    The text is parsed below a generator, which filters on what it says do not pass: each would parse it once more.
    """
    text = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return df.select(*keep, F.explode(F.array(F.from_json(text, schema))).alias("d")).select(*keep, "d.*")


def totals(charges: DataFrame, *by: str) -> DataFrame:
    """Row count and exact sums of a mapped feed."""
    typed = nz.tolerant_cast(charges)
    six = lambda c: F.sum(F.round(c, 6)).cast("double").alias(c)
    return typed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), six(COST), six(LIST), six("BilledCost"))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _by_category(names: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for category, name in names.items():
        out = F.when(F.col("ServiceCategory") == category, name).otherwise(out)
    return out


def _record(**fields: Column) -> Column:
    """A record without its null fields."""
    return F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))


def aws(c: DataFrame) -> DataFrame:
    service = _by_category({"Compute": "AWS Lambda", "Storage": "Amazon FSx", "Databases": "Amazon Aurora",
                            "Analytics": "AWS Glue", "AI and Machine Learning": "Amazon Bedrock"}, "Unlisted")
    metric = lambda v: F.struct(v.alias("Amount"), F.lit("EUR").alias("Unit"))
    metrics = F.create_map(F.lit("AmortizedCost"), metric(_text(COST)), F.lit("UnblendedCost"), metric(_text(LIST)),
                           F.lit("UsageQuantity"), metric(_text("ConsumedQuantity")))
    period = F.struct(_text("ChargePeriodStart").alias("Start"), _text("ChargePeriodEnd").alias("End"))
    groups = F.array(F.struct(F.array(service, F.coalesce("SubAccountId", F.lit("none"))).alias("Keys"), metrics.alias("Metrics")))
    docs = documents(c, pl.SCHEMAS["aws_cost_explorer"],
                     ResultsByTime=F.array(F.struct(period.alias("TimePeriod"), groups.alias("Groups"))))
    out = pl.aws_cost_explorer(docs, START, END).withColumn("period", F.col("BillingPeriodStart").cast("date"))
    return totals(out, "ServiceCategory", "BillingCurrency", "period")


def azure(c: DataFrame) -> DataFrame:
    service = _by_category({"Compute": "Virtual Machines", "Storage": "Azure Backup", "Security": "Key Vault"}, "Unlisted")
    names = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("Cost", "UsageDate", "ServiceName", "ResourceGroup", "Currency")])
    row = F.array(_text(COST), F.date_format("ChargePeriodStart", "yyyyMMdd"), service, F.col("tag_application"), F.lit("USD"))
    row = F.when(F.col("charge_key") % 3 == 0, F.slice(row, 1, 4)).when(F.col("charge_key") % 3 == 1, F.array_append(row, F.lit("more"))).otherwise(row)
    docs = documents(c, pl.SCHEMAS["azure_query"], properties=F.struct(names.alias("columns"), F.array(row).alias("rows")))
    out = pl.azure_query(docs, START, END, "sub-1").withColumns({
        "day": F.col("ChargePeriodStart").cast("date"), "resource_group": F.try_element_at("Tags", F.lit("resource_group"))})
    return totals(out, "ServiceCategory", "day", "resource_group")


def gcp(c: DataFrame) -> DataFrame:
    service = _by_category({"Compute": "Cloud Run", "Analytics": "BigQuery", "Networking": "Cloud NAT"}, "Unlisted")
    half = F.struct(((F.col(COST) - F.col(LIST)) / 2).cast("double").alias("amount"))
    labels = F.array(*[F.struct(F.lit("app").alias("key"), v.alias("value")) for v in (F.lit("old"), F.col("tag_application"))])
    docs = documents(
        c, pl.SCHEMAS["gcp_detailed"], service=F.struct(service.alias("description")),
        sku=F.struct(F.col("SkuId").alias("id")), location=F.struct(F.col("RegionId").alias("region")),
        usage_start_time=F.col("ChargePeriodStart").cast("timestamp_ntz"),
        usage_end_time=F.col("ChargePeriodEnd").cast("timestamp_ntz"), cost=F.col(LIST).cast("double"),
        usage=F.struct(F.col("ConsumedQuantity").alias("amount")), labels=labels, credits=F.array(half, half))
    return totals(nz.explode_tags(pl.gcp_detailed(docs, START, END)), "ServiceCategory", "tag_application", "RegionId")


def cloudability(c: DataFrame) -> DataFrame:
    odd = F.col("charge_key") % 2 == 1
    docs = documents(c, pl.flat_schema("cloudability"), results=_record(
        vendor=F.col("ProviderName"), amortized_cost=F.when(odd, _text(COST)), amortizedCost=F.when(~odd, _text(COST)),
        list_cost=F.when(odd, _text(LIST)), region=F.col("RegionId"), service_name=F.col("ServiceName")))
    return totals(pl.flat_costs(docs, "cloudability", START, END), "ProviderName", "ServiceName", "RegionId")


def cloudhealth(c: DataFrame) -> DataFrame:
    member = lambda v: F.array(F.create_map(F.lit("label"), v))
    dims = F.array(F.create_map(F.lit("time"), member(F.date_format("ChargePeriodStart", "yyyy-MM"))),
                   F.create_map(F.lit("AWS-Account"), member(F.coalesce("SubAccountId", F.lit("none")))),
                   F.create_map(F.lit("AWS-Service-Category"), member(F.col("ServiceCategory"))))
    cube = F.array(F.array(F.array(F.array(F.col(LIST).cast("double")))))
    docs = documents(c, pl.SCHEMAS["cloudhealth"], dimensions=dims, data=cube)
    out = pl.cloudhealth(docs, START, END).withColumn("period", F.col("ChargePeriodStart").cast("date"))
    return totals(out, "BillingAccountId", "ServiceName", "period")


def finout(c: DataFrame) -> DataFrame:
    cell = lambda v: F.struct(v.cast("double").alias("amount"), F.lit("USD").alias("unit"))
    docs = documents(c, f"data array<{pl.RECORD}>", data=_record(
        _billing_dimension_provider=F.lower("ProviderName"), _billing_dimension_service=F.col("ServiceName"),
        amortizedCost_sum=cell(F.col(COST)), listCost_sum=cell(F.col(LIST)), usageAmount_sum=F.col("ConsumedQuantity")))
    return totals(pl.finout(docs, START, END), "ProviderName", "ServiceName")


def flexera(c: DataFrame) -> DataFrame:
    value = F.struct(
        F.struct(F.lower("ProviderName").alias("vendor"), F.col("SubAccountId").alias("vendor_account"),
                 F.col("ServiceName").alias("service")).alias("dimensions"),
        F.struct(_text(COST).alias("cost_amortized_unblended_adj"),
                 F.when(F.col("charge_key") % 2 == 0, _text(LIST)).alias("cost_nonamortized_unblended_adj")).alias("metrics"))
    docs = documents(c, pl.SCHEMAS["flexera"], values=F.array(value))
    return totals(pl.flat_costs(docs, "flexera", START, END), "ProviderName", "SubAccountId")


def flat_vendors(c: DataFrame) -> DataFrame:
    """Each provider's rows through another vendor's spelling of the same fields."""
    day, cost, service, provider = _text("ChargePeriodStart"), _text(COST), F.col("ServiceName"), F.lower("ProviderName")
    feeds = {
        "vantage": ("AWS", "costs", dict(amount=cost, provider=provider, service=service, accrued_at=day)),
        "cloudzero": ("Azure", "data", dict(real_cost=cost, cloud_provider=provider, element=service, usage_date=day)),
        "nops": ("GCP", "results", dict(total=cost, service=service, period=day)),
        "harness": ("OCI", "gridData", dict(value=cost, name=service)),
        "servicenow": ("IBM Cloud", "result", dict(u_cost=cost, provider=provider, u_service=service, u_date=day)),
    }
    frames = [pl.flat_costs(documents(c.filter(F.col("ProviderName") == cloud), pl.flat_schema(vendor),
                                      **{container: _record(**fields)}), vendor, START, END)
              for vendor, (cloud, container, fields) in feeds.items()]
    out = pl.union(frames).withColumn("period", F.col("BillingPeriodStart").cast("date"))
    return totals(out, "InvoiceIssuerName", "ProviderName", "ServiceName", "ChargeDescription", "period")


def kubecost(c: DataFrame) -> DataFrame:
    name = F.when(F.col("ConsumedQuantity") == 0, "__idle__").otherwise(F.coalesce("ResourceId", F.lit("unnamed")))
    block = F.create_map(name, F.struct(_text(COST).alias("totalCost"), F.lit("0.5").alias("totalEfficiency")))
    as_list = documents(c.filter("charge_key % 2 = 0"), pl.SCHEMAS["kubecost"], data=F.array(block))
    as_object = documents(c.filter("charge_key % 2 = 1"), pl.SCHEMAS["kubecost"], data=block)
    out = pl.kubecost(as_list.union(as_object), START, END)
    return totals(out.withColumn("idle", F.col("ConsumedQuantity") == 0), "ResourceType", "ResourceId", "idle")


def recommendations(c: DataFrame) -> DataFrame:
    """Idle rows as findings of five sources, in each source's shape."""
    idle = c.filter((F.col("ConsumedQuantity") == 0) & (F.col(COST) > 0) & (F.col("ChargeCategory") == "Usage"))
    of = lambda cloud: idle.filter(F.col("ProviderName") == cloud)
    record, resource, odd = f"array<{pl.RECORD}>", F.col("ResourceId"), F.col("charge_key") % 2 == 1
    hub = documents(of("AWS"), f"items {record}", items=_record(
        actionType=F.when(odd, "Stop").otherwise("Refactor"), resourceId=resource, estimatedMonthlySavings=_text(COST)))
    extended = F.struct(F.when(odd, _text(COST)).alias("savingsAmount"), (F.col(COST) * 12).cast("string").alias("annualSavingsAmount"))
    properties = F.struct(
        F.struct(resource.alias("resourceId")).alias("resourceMetadata"), F.col("ResourceType").alias("impactedField"),
        F.struct(F.when(odd, "Buy a reservation").otherwise("Resize").alias("solution")).alias("shortDescription"), extended.alias("extendedProperties"))
    advisor = documents(
        of("Azure"), f"value array<struct<properties: struct<resourceMetadata: struct<resourceId: string>, impactedField: string, "
                     f"shortDescription: {pl.RECORD}, extendedProperties: {pl.RECORD}, impact: string, category: string>>>",
        value=F.array(F.struct(properties.alias("properties"))))
    units = F.floor(COST)
    nanos = ((F.col(COST) - units) * 1000000000).cast("bigint")
    cost = F.struct((-units).cast("string").alias("units"), (-nanos).cast("string").alias("nanos"))
    found = F.struct(resource.alias("name"), F.struct(F.struct(cost.alias("cost")).alias("costProjection")).alias("primaryImpact"))
    recommender = documents(
        of("GCP"), f"recommender string, recommendations array<struct<name: string, recommenderSubtype: string, priority: string, "
                   f"stateInfo: struct<state: string>, primaryImpact: struct<costProjection: struct<cost: {pl.RECORD}>>>>",
        recommender=F.lit("google.compute.disk.IdleResourceRecommender"), recommendations=F.array(found))
    oracle = documents(of("OCI"), f"items {record}", items=_record(
        name=F.when(odd, "idle-load-balancer").otherwise("other-thing"), estimated_cost_saving=F.when(odd, _text(COST)).otherwise("0")))
    finout_docs = documents(of("IBM Cloud"), f"data {record}", data=_record(
        resourceId=resource, scan_type=F.lit("idle"), groupYearlyPotentialSavings=(F.col(COST) * 12).cast("string")))
    rows = pl.union([pl.aws_hub(hub), pl.azure_advisor(advisor), pl.gcp_recommender(recommender), pl.oci_advisor(oracle, "t"),
                     pl.flat_findings(finout_docs, "finout")])
    saved = F.sum(F.round(F.col("estimated_monthly_savings").cast("decimal(28,9)"), 6)).cast("double")
    return rows.groupBy("source", "cloud", "lever").agg(F.count(F.lit(1)).alias("findings"), saved.alias("monthly"))


def budgets(c: DataFrame) -> DataFrame:
    plan = bu.budget_from_history(c).withColumn("cents", F.round(F.col("budget") * 100).cast("bigint"))
    of = lambda cloud: plan.filter(F.col("cloud") == cloud)
    record, amount, name = f"array<{pl.RECORD}>", (F.col("cents") / 100).cast("string"), F.col("application")
    aws_docs = documents(of("AWS"), f"Budgets {record}", Budgets=_record(
        BudgetName=name, BudgetLimit=F.struct(amount.alias("Amount"), F.lit("USD").alias("Unit"))))
    split = F.struct(F.floor(F.col("cents") / 100).cast("string").alias("units"),
                     ((F.col("cents") % 100) * 10000000).alias("nanos"))
    gcp_docs = documents(of("GCP"), f"budgets {record}", budgets=_record(
        displayName=name, amount=F.struct(split.alias("specifiedAmount"))))
    cloudability_docs = documents(of("Azure"), f"result {record}, results {record}", results=_record(
        start_date=_text("period"), vendor=F.col("cloud"), name=name, budgetAmount=amount))
    harness_docs = documents(of("OCI"), f"data {record}, resource {record}", data=_record(
        startTime=_text("period"), name=name, amount=amount))
    rows = pl.union([pl.cloud_budgets(aws_docs, "AWS", TODAY), pl.cloud_budgets(gcp_docs, "GCP", TODAY),
                     pl.flat_budgets(cloudability_docs, "cloudability"), pl.flat_budgets(harness_docs, "harness")])
    total = F.sum(F.round(F.col("budget").cast("decimal(28,9)"), 2)).cast("double")
    return rows.groupBy("cloud", "application", "period").agg(F.count(F.lit(1)).alias("budgets"), total.alias("budget"))


def gathered(df: DataFrame, record: Column, *keep: str) -> DataFrame:
    """`found`, the records of up to 64 neighbouring charge keys: what goes into one document."""
    return df.groupBy(*keep, F.floor(F.col("charge_key") / 64).alias("doc")).agg(F.collect_list(record).alias("found"))


def cloudhealth_cubes(c: DataFrame) -> DataFrame:
    """Cubes of a year's months, many accounts and services, one per provider, year and hash part of the accounts.

    A cell the charges have nothing for is null.
    """
    account = F.coalesce("SubAccountId", F.lit("none"))
    cells = c.groupBy("ProviderName", F.year("ChargePeriodStart").alias("y"), F.pmod(F.xxhash64(account), F.lit(16)).alias("part"),
                      F.date_format("ChargePeriodStart", "yyyy-MM").alias("m"), account.alias("a"), F.col("ServiceCategory").alias("s")).agg(
        F.sum(LIST).cast("double").alias("cost"))
    key = lambda m, a, s: F.concat_ws("|", m, a, s)
    cubes = cells.groupBy("ProviderName", "y", "part").agg(
        *[F.array_sort(F.collect_set(x)).alias(f"{x}s") for x in "mas"],
        F.map_from_entries(F.collect_list(F.struct(key(F.col("m"), F.col("a"), F.col("s")), "cost"))).alias("cells"))
    data = F.transform("ms", lambda m: F.transform("as", lambda a: F.transform("ss", lambda s: F.array(F.try_element_at("cells", key(m, a, s))))))
    named = lambda field, values: F.transform(values, lambda v: F.create_map(F.lit(field), v))
    dims = F.array(F.create_map(F.lit("time"), named("name", F.col("ms"))), F.create_map(F.lit("AWS-Account"), named("label", F.col("as"))),
                   F.create_map(F.lit("AWS-Service-Category"), named("label", F.col("ss"))))
    out = pl.cloudhealth(documents(cubes, pl.SCHEMAS["cloudhealth"], dimensions=dims, data=data), START, END)
    return totals(out.withColumn("period", F.col("ChargePeriodStart").cast("date")), "BillingAccountId", "ServiceName", "period")


def vendor_recommendations(c: DataFrame) -> DataFrame:
    """Idle rows as findings of the seven other sources, dealt by key, many in one document of each source's shape."""
    idle = c.filter((F.col("ConsumedQuantity") == 0) & (F.col(COST) > 0) & (F.col("ChargeCategory") == "Usage"))
    of = lambda slot: idle.filter(F.col("charge_key") % 7 == slot)
    odd, cost, resource, provider = F.col("charge_key") % 2 == 1, _text(COST), F.col("ResourceId"), F.lower("ProviderName")
    amount = lambda v: F.struct(v.alias("EstimatedMonthlySavings"))
    targets = F.array(amount((F.col(COST) / 2).cast("string")), amount(cost))
    right = F.struct(
        F.col("SubAccountId").alias("AccountId"), F.when(odd, "TERMINATE").otherwise("MODIFY").alias("RightsizingType"),
        F.struct(resource.alias("ResourceId")).alias("CurrentInstance"),
        F.when(~odd, F.struct(targets.alias("TargetInstances"))).alias("ModifyRecommendationDetail"),
        F.when(odd, amount(cost)).alias("TerminateRecommendationDetail"))
    rightsizing = documents(
        gathered(of(0), right), "RightsizingRecommendations array<struct<AccountId: string, RightsizingType: string, "
        "CurrentInstance: struct<ResourceId: string>, ModifyRecommendationDetail: struct<TargetInstances: array<struct<EstimatedMonthlySavings: string>>>, "
        "TerminateRecommendationDetail: struct<EstimatedMonthlySavings: string>>>", RightsizingRecommendations=F.col("found"))
    saving = lambda v: F.struct(v.alias("savings"))
    item = F.struct(F.when(odd, resource).alias("resourceIdentifier"), resource.alias("resourceId"),
                    F.array(saving(cost), saving((F.col(COST) * 2).cast("string"))).alias("recommendations"))
    items = f"array<struct<resourceIdentifier: string, resourceId: string, recommendations: array<{pl.RECORD}>>>"
    cloudability_docs = documents(gathered(of(1), item, "ProviderName"), f"vendor string, service string, result {items}, results {items}",
                                  vendor=provider, service=F.lit("ec2"), results=F.col("found"))

    def flat(vendor: str, slot: int, container: str, **fields: Column) -> DataFrame:
        record = F.struct(*[v.alias(k) for k, v in fields.items()])
        schema = ", ".join(f"{name} array<{pl.RECORD}>" for name in pl.FLAT_FINDINGS[vendor].containers)
        return pl.flat_findings(documents(gathered(of(slot), record), schema, **{container: F.col("found")}), vendor)

    actions = documents(
        of(5), f"actionType string, details string, target {pl.RECORD}, currentEntity {pl.RECORD}, savingsAmount string, risk struct<severity: string>",
        actionType=F.when(odd, "SUSPEND"), target=F.struct(resource.alias("uuid"), provider.alias("environmentType")), savingsAmount=cost)
    rows = pl.union([
        pl.aws_rightsizing(rightsizing), pl.cloudability_rightsizing(cloudability_docs),
        flat("cloudhealth", 2, "nodes", cloud=provider, resourceId=resource, estimatedMonthlySavings=cost),
        flat("harness", 3, "items", cloudProvider=provider, resourceName=F.when(odd, resource), id=resource, monthlySavings=cost,
             recommendationType=F.when(odd, "NODE")),
        flat("nops", 4, "data", instance_id=resource, savings=cost, lever=F.when(odd, "compute-copilot")),
        pl.turbonomic(actions),
        flat("vantage", 6, "recommendations", provider=provider, token=resource, potential_savings=cost, category=F.when(odd, "idle"))])
    saved = F.sum(F.round(F.col("estimated_monthly_savings").cast("decimal(28,9)"), 6)).cast("double")
    return rows.groupBy("source", "cloud", "lever").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("resource_id").alias("resources"), saved.alias("monthly"))


def other_budgets(c: DataFrame) -> DataFrame:
    """Budgets in the shapes of Azure, OCI and Flexera, all months of an application in one document."""
    plan = bu.budget_from_history(c).withColumn("cents", F.round(F.col("budget") * 100).cast("bigint"))
    amount, name = (F.col("cents") / 100).cast("string"), F.col("application")

    def docs(cloud: str, container: str, schema: str = "", **fields: Column) -> DataFrame:
        found = plan.filter(F.col("cloud") == cloud).groupBy("application").agg(
            F.collect_list(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("found"))
        return documents(found, f"{container} array<{pl.RECORD}>{schema}", **{container: F.col("found")})

    rows = pl.union([
        pl.cloud_budgets(docs("Azure", "value", name=name, properties=F.struct(amount.alias("amount"))), "Azure", TODAY),
        pl.cloud_budgets(docs("OCI", "items", display_name=name, amount=amount), "OCI", TODAY),
        pl.flat_budgets(docs("IBM Cloud", "budgets", f", values array<{pl.RECORD}>", vendor=F.col("cloud"), name=name, start_at=_text("period"),
                             budget=amount), "flexera")])
    total = F.sum(F.round(F.col("budget").cast("decimal(28,9)"), 2)).cast("double")
    return rows.groupBy("cloud", "application", "period").agg(F.count(F.lit(1)).alias("budgets"), total.alias("budget"))


on_charges("V01_aws_cost_explorer", aws)
on_charges("V02_azure_query", azure)
on_charges("V03_gcp_detailed", gcp)
on_charges("V04_cloudability", cloudability)
on_charges("V05_cloudhealth", cloudhealth)
on_charges("V06_finout", finout)
on_charges("V07_flexera", flexera)
on_charges("V08_flat_vendors", flat_vendors)
on_charges("V09_kubecost", kubecost)
on_charges("V10_recommendations", recommendations)
on_charges("V11_budgets", budgets)
on_charges("V05b_cloudhealth_cubes", cloudhealth_cubes)
on_charges("V10b_vendor_recommendations", vendor_recommendations)
on_charges("V11b_other_budgets", other_budgets)
