"""Rule-based savings opportunities in one pass over the charges.

Charges are summed per cloud, resource type, resource and month first, with a conditional sum for
each detector. That aggregate has a map-side part, so a resource, cloud or detector holding much of
the data arrives as few rows. Only its rows are dealt to the detectors they matter to and summed per
(detector, group, cloud, month). Everything after works on detector groups (tens of rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendframe.functions.columns import COST, LIST, has_commitment, month, pct, ratio, usage
from spendframe.functions.focus import COMMITMENT_ELIGIBLE, UNALLOCATED
from spendframe.operators.kpi import esr_pct
from spendframe.operators.levers import LEVERS, PROFILES

# --- fixed values: detector constants ----------------------------------------------------
IDLE_LEVERS = {"Volume": "U4", "LoadBalancer": "U5", "IpAddress": "U6", "Gateway": "U7", "Snapshot": "U8"}
WASTE_LEVERS = ["U4", "U5", "U6", "U7", "U8", "U10"]
MIN_MONTHLY = 50.0
NONPROD = ["nonprod", "dev", "test", "staging"]
PREVIOUS_GENERATION = r"m4\.|c4\.|r4\.|t2\.|_v2|n1-|VM\.Standard2\."
ALREADY_ARM = r"m7g|c4a|D4as|Cobalt|Ampere|Axion|\.A1\."
ALWAYS_ON_HOURS = 648.0
AI_SPLITS = [("G3", 0.20), ("G4", 0.12), ("G9", 0.08)]

DETECTORS = [f"O{i:02d}" for i in range(1, 13)]
#: Detectors with one opportunity per cloud; the others span clouds.
PER_CLOUD = ["O01", "O02", "O07", "O08", "O09", "O10"]
#: Detectors that report how many resources they found.
COUNTED = ["O01r", "O03", "O04", "O05", "O06", "O07", "O08", "O09", "O10"]


def _tags(prefix: str = "tag_") -> dict[str, Column]:
    """Tag -> condition. `O01` carries months and `O01r` resources of the same rows; `O12t` is
    the total `O12` is compared with."""
    qty, cost, sku = F.col("ConsumedQuantity"), F.col(COST), F.coalesce("SkuId", F.lit(""))
    env, compute = F.col(f"{prefix}environment"), F.col("ServiceCategory") == "Compute"
    standard = F.col("PricingCategory") == "Standard"
    gap = usage() & ~has_commitment() & F.col("ServiceCategory").isin(COMMITMENT_ELIGIBLE) & standard
    running = env.isin(NONPROD) & compute & usage() & (qty > 0)
    return {
        "O01": gap,
        "O01r": gap,
        "O02": has_commitment() & (F.col("CommitmentDiscountStatus") == "Unused"),
        "O03": (qty == 0) & (cost > 0) & usage() & F.col("ResourceType").isin(list(IDLE_LEVERS)),
        "O04": sku.contains("gp2") & (qty > 0),
        "O05": compute & sku.rlike(PREVIOUS_GENERATION),
        "O06": running & F.col("ResourceId").isNotNull(),
        "O07": running & standard,
        "O08": compute & usage() & (qty > 0) & ~sku.rlike(ALREADY_ARM),
        "O09": sku.contains("license-included") & usage(),
        "O10": (F.col("ServiceCategory") == "Storage") & (env == "prod")
               & F.col("ResourceType").isin("Volume", "Object") & (qty > 0),
        "O11": (F.col("ServiceCategory") == "AI and Machine Learning") & usage(),
        "O12": usage() & (F.col(f"{prefix}application") == UNALLOCATED),
        "O12t": usage(),
    }


def _summed(charges: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """One row per cloud, resource type, resource and month: per tag whether a row has it, and its sums."""
    rows = charges.select("ProviderName", "ResourceType", "ResourceId", month().alias("m"), COST, LIST, "ConsumedQuantity",
                          *[cond.alias(f"_is_{tag}") for tag, cond in tags.items()])
    hit = {tag: F.col(f"_is_{tag}") for tag in tags}
    sums = [F.bool_or(h).alias(f"_has_{tag}") for tag, h in hit.items()] + [F.sum(F.when(h, F.col(COST))).alias(f"_cost_{tag}") for tag, h in hit.items()]
    extra = [F.sum(F.when(hit[tag], F.col(of))).alias(f"_{name}") for tag, of, name in (("O01", LIST, "list"), ("O06", "ConsumedQuantity", "qty")) if tag in hit]
    return rows.groupBy("ProviderName", "ResourceType", "ResourceId", "m").agg(*sums, *extra)


def _per_resource(report: DataFrame, tags: list[str]) -> DataFrame:
    """What has to be decided per resource: which ones stay, and where each counts once (`_new_`).

    O06 keeps a resource when any of its months reaches 648 hours, with all its months. A resource counts in the
    first of its rows in a group, so distinct counts are plain sums afterwards. One shuffle by resource
    serves both; a resource is a few rows by now.
    """
    if "O06" in tags:
        hours = F.sum("_qty").over(Window.partitionBy("ResourceId", "m"))
        peak = F.max(F.when(F.col("_has_O06"), F.col("_hours"))).over(Window.partitionBy("ResourceId"))
        report = report.withColumn("_hours", hours).withColumn("_has_O06", F.col("_has_O06") & (peak >= ALWAYS_ON_HOURS)).drop("_hours")
    own = F.struct("m", "ProviderName", "ResourceType")
    for tag in (t for t in COUNTED if t in tags):
        group = {"O03": ["ResourceType"]}.get(tag, ["ProviderName"] if tag[:3] in PER_CLOUD else [])
        has = F.col(f"_has_{tag.rstrip('r')}")
        first = F.min(F.when(has, own)).over(Window.partitionBy("ResourceId", *group)).eqNullSafe(own)
        report = report.withColumn(f"_new_{tag}", (has & first & F.col("ResourceId").isNotNull()).cast("int"))
    return report


def _tagged(charges: DataFrame, detectors: list[str]) -> DataFrame:
    """One row per tag that a row of the summed charges has, with its sums.

    The tag `_` marks the months of the whole frame; every row carries it.
    """
    tags = {tag: cond for tag, cond in _tags().items() if tag[:3] in detectors}
    report = _per_resource(_summed(charges, {tag: cond for tag, cond in tags.items() if tag != "O01r"}), list(tags))
    types = dict(charges.dtypes)

    def entry(tag: str) -> Column:
        own = tag.rstrip("r")
        values = {"cost": F.col(f"_cost_{own}") if own in tags else F.lit(None).cast(types[COST]),
                  "list": F.col("_list") if own == "O01" else F.lit(None).cast(types[LIST]),
                  "new": F.col(f"_new_{tag}") if tag in COUNTED else F.lit(0)}
        return F.struct(F.lit(tag).alias("tag"), *[v.alias(k) for k, v in values.items()])

    hits = F.array(entry("_"), *[F.when(F.col(f"_has_{tag.rstrip('r')}"), entry(tag)) for tag in tags])
    return report.select("ProviderName", "ResourceType", "m", F.explode(F.array_compact(hits)).alias("e")).select(
        "ProviderName", "ResourceType", "m", "e.*")


def detector_groups(charges: DataFrame, detectors: list[str] = DETECTORS) -> DataFrame:
    """One row per detector and group: sums, distinct resources, clouds, months of the frame.

    `series` is the month list of the two detectors that look at time (O01, O11).
    """
    tag, det = F.col("tag"), F.col("det")
    sums = _tagged(charges, detectors).withColumn("det", F.when(tag == "_", "_").otherwise(tag.substr(1, 3)))
    monthly = tag.isin("O01", "O11")
    # From here on the rows are a report: detector, group, cloud and, for some, month.
    report = sums.groupBy(
        "det", F.when(det == "O03", F.col("ResourceType")).when(det.isin(PER_CLOUD), F.col("ProviderName")).alias("grp"), "tag",
        F.when(~tag.isin("_", "O12t"), F.col("ProviderName")).alias("cloud"), F.when(tag.isin("_", "O01", "O11"), F.col("m")).alias("m"),
    ).agg(F.sum("cost").alias("cost"), F.sum("list").alias("list"), F.sum("new").alias("new"))
    entry = F.when(monthly, F.struct("m", F.col("cost").cast("double").alias("cost"), F.col("list").cast("double").alias("list")))
    dollars = ~F.col("tag").isin("O01r", "O12t", "_")
    groups = report.groupBy("det", "grp").agg(
        F.sum(F.when(dollars, F.col("cost"))).cast("double").alias("cost"),
        F.sum(F.when(F.col("tag") == "O12t", F.col("cost"))).cast("double").alias("all_cost"),
        F.sum("new").alias("resource_count"),
        F.array_sort(F.collect_set("cloud")).alias("clouds"),
        F.collect_list(entry).alias("series"),
        F.size(F.collect_set("m")).alias("frame_months"))
    # The `_` group exists for any non-empty frame; its month set is the divisor for all groups.
    months = F.max(F.when(F.col("det") == "_", F.col("frame_months"))).over(Window.partitionBy())
    label = F.when(F.size("clouds") > 0, F.array_join("clouds", ", ")).otherwise("Multi-cloud")
    return (groups.withColumn("months", F.greatest(months, F.lit(1))).filter("det <> '_'")
            .withColumn("label", label).drop("frame_months", "clouds"))


def _profile(position: int) -> Column:
    """A profile value by cloud; null for a cloud without one."""
    out = F.lit(None)
    for cloud, values in PROFILES.items():
        out = F.when(F.col("grp") == cloud, values[position]).otherwise(out)
    return out


def _series_by_month(value: str) -> Column:
    """Sorted month totals of one measure from `series` (clouds of a month added up)."""
    months = F.array_sort(F.array_distinct(F.transform("series", lambda e: e["m"])))
    return F.transform(months, lambda m: F.aggregate(
        F.filter("series", lambda e: e["m"] == m), F.lit(0.0), lambda acc, e: acc + e[value]))


def _tail(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def _growth(costs: Column) -> Column:
    """Month-over-month growth per month from the second on; null after an empty month pair."""
    def step(cur: Column, i: Column) -> Column:
        prior = F.get(costs, i)
        return F.when(prior != 0, cur / prior - 1.0).when(cur > 0, F.lit(float("inf"))).when(
            cur < 0, F.lit(float("-inf")))
    return F.transform(F.slice(costs, 2, F.greatest(F.size(costs) - 1, F.lit(0))), step)


def _mean(array: Column) -> Column:
    known = F.filter(array, lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))


def _evidence(**items: Column) -> Column:
    """Evidence as a map of text, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in items.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def _r2(value: Column) -> Column:
    return F.round(value, 2)


def _with_trends(groups: DataFrame, detectors: list[str]) -> DataFrame:
    """Trailing list costs for O01; growth, last month and lever splits for O11."""
    if "O01" in detectors:
        groups = groups.withColumn("trailing", F.when(F.col("det") == "O01", _tail(_series_by_month("list"), 6)))
        groups = groups.withColumns({"floor": F.array_min("trailing"), "peak": F.array_max("trailing")})
    if "O11" in detectors:
        here = F.col("det") == "O11"
        groups = groups.withColumn("ai", F.when(here, _series_by_month("cost")))
        # Growth entries miss the first month, which never counts; fewer than six are all taken.
        groups = groups.withColumns({"growth": _mean(_tail(_growth(F.col("ai")), 6)),
                                     "recent": F.try_element_at("ai", F.lit(-1))})
        growing = (F.size("ai") >= 3) & (F.col("growth") > 0.15) & (F.col("recent") > 0)
        splits = F.array(*[F.struct(F.lit(k).alias("lever"), F.lit(r).alias("rate")) for k, r in AI_SPLITS])
        usable = F.filter(splits, lambda s: (s["lever"] != "G9") | F.col("label").contains("AWS"))
        groups = groups.withColumn("split", F.explode_outer(F.when(here & growing, usable)))
        groups = groups.filter(~here | F.col("split").isNotNull())
    return groups


def _opportunities(groups: DataFrame, detectors: list[str]) -> DataFrame:
    """Lever, scope, raw monthly value, confidence and evidence per detector group."""
    det, grp, cost, months = F.col("det"), F.col("grp"), F.col("cost"), F.col("months")
    per_month = cost / months
    g = _with_trends(groups, detectors)
    floor, peak, trailing = F.col("floor"), F.col("peak"), F.col("trailing")
    growth, recent = F.col("growth"), F.col("recent")

    idle = F.lit(None)
    for kind, lever in IDLE_LEVERS.items():
        idle = F.when(grp == kind, lever).otherwise(idle)
    azure, oci = grp == "Azure", grp == "OCI"
    licence_rate = F.when(azure, 0.36).when(oci, 0.40).otherwise(0.30)

    def pick(**by: Column) -> Column:
        """The value of the row's detector, over the detectors asked for."""
        out = F.lit(None)
        for name, value in by.items():
            if name in detectors:
                out = F.when(det == name, value).otherwise(out)
        return out

    lever = pick(O01=_profile(1), O02=F.lit("R21"), O03=idle, O04=F.lit("U15"), O05=F.lit("U17"), O06=F.lit("U10"),
                 O07=F.when(_profile(2).isNotNull(), "R9"), O08=_profile(3),
                 O09=F.when(azure, "R11").when(oci, "R20").otherwise("R12"), O10=_profile(4),
                 O11=F.col("split.lever"), O12=F.lit("U18"))
    monthly = pick(
        O01=floor * _profile(0), O02=per_month, O03=per_month, O04=per_month * 0.20, O05=per_month * 0.125,
        O06=per_month * 0.65, O07=per_month * (_profile(2) * 0.40), O08=per_month * 0.20 * 0.35,
        O09=F.when(cost > 0, per_month * licence_rate), O10=per_month * 0.25 * 0.35,
        O11=recent * F.col("split.rate"),
        O12=F.when((cost != 0) & (F.coalesce("all_cost", F.lit(0.0)) != 0), 0.0))
    confidence = pick(
        O01=F.lit(0.8), O02=F.lit(1.0), O03=F.lit(0.9), O04=F.lit(0.8), O05=F.lit(0.7), O06=F.lit(0.7), O07=F.lit(0.6),
        O08=F.lit(0.6), O09=F.when(azure, 0.65).when(oci, 0.60).otherwise(0.50), O10=F.lit(0.5), O11=F.lit(0.45),
        O12=F.lit(0.9))
    scope = pick(
        O01=F.format_string("%s commitment-eligible usage (uncovered)", grp),
        O02=F.format_string("%s unused commitment (reduce / improve utilization)", grp),
        O03=F.format_string("Idle %s resources", grp), O04=F.lit("gp2 EBS volumes"),
        O05=F.lit("Previous-generation compute families"), O06=F.lit("Non-prod compute running 24x7"),
        O07=F.format_string("%s non-prod compute (Spot-eligible)", grp),
        O08=F.format_string("%s x86 compute (ARM-migratable)", grp), O09=F.lit("License-included compute"),
        O10=F.format_string("%s prod storage (cold-tier candidate)", grp),
        O11=F.format_string("AI/ML spend growing %.0f%%/mo", growth * 100),
        O12=F.lit("Untagged / unallocated spend"))
    cloud = F.when(det.isin(PER_CLOUD), grp).otherwise(F.col("label"))
    uncounted = det.isin("O02", "O11", "O12")
    evidence = _evidence(
        months_observed=F.coalesce(pick(O01=F.size(trailing)), F.when(~det.isin("O11", "O12"), months)),
        floor=pick(O01=_r2(floor)), peak=pick(O01=_r2(peak)),
        spend=F.when(~det.isin("O01", "O11"), _r2(cost)),
        recent_monthly=pick(O11=_r2(recent)), avg_mom_pct=pick(O11=F.round(growth * 100, 1)),
        share_of_usage_pct=pick(O12=F.round(pct(cost, F.col("all_cost")), 1)),
        rate=pick(O01=_profile(0), O04=F.lit(0.20), O05=F.lit(0.125), O06=F.lit(0.65), O07=_profile(2) * 0.40,
                  O08=F.lit(0.07), O09=licence_rate, O10=F.lit(0.0875), O11=F.col("split.rate")))
    return g.select("det", lever.alias("lever_id"), cloud.alias("cloud"), scope.alias("scope"), monthly.alias("raw"),
                    confidence.alias("confidence"), evidence.alias("evidence"),
                    F.when(uncounted, 0).otherwise(F.col("resource_count")).cast("bigint").alias("resource_count"))


def detect(charges: DataFrame, detectors: list[str] = DETECTORS) -> DataFrame:
    """The opportunities of the chosen detectors, at least $50 a month each or exactly 0.

    Clouds without a profile get no rate, spot, ARM or tiering opportunity. A group without a
    cloud or resource type is left out, as grouping keys must be known.
    """
    known = F.col("grp").isNotNull() | ~F.col("det").isin([*PER_CLOUD, "O03"])
    found = _opportunities(detector_groups(charges, detectors).filter(known), detectors)
    found = found.filter(F.col("lever_id").isNotNull() & ((F.col("raw") >= MIN_MONTHLY) | (F.col("det") == "O12")))
    found = found.withColumn("monthly_savings", F.round("raw", 2)).filter(
        (F.col("monthly_savings") >= MIN_MONTHLY) | (F.col("monthly_savings") == 0))
    # The catalogue is a fixed list of 59 rows, so it is safe to broadcast.
    levers = charges.sparkSession.createDataFrame(
        [(i, n, c, e, r, t) for i, n, c, _, _, _, e, r, t in LEVERS],
        "lever_id string, lever_name string, category string, effort string, risk string, time_to_value string")
    out = found.join(F.broadcast(levers), "lever_id")
    flag = F.col("det") == "O12"  # a governance prerequisite under its closest lever
    scope = F.when(F.col("det") == "O11", F.concat_ws(" -- ", "scope", "lever_name")).otherwise(F.col("scope"))
    return out.select(
        F.col("det").alias("detector"), "lever_id",
        F.when(flag, "Tag / allocation coverage remediation").otherwise(F.col("lever_name")).alias("lever_name"),
        "category", "cloud", scope.alias("scope"), "monthly_savings",
        F.round(F.col("monthly_savings") * 12.0, 2).alias("annual_savings"),
        F.when(flag, "Medium").otherwise(F.col("effort")).alias("effort"), "risk",
        F.when(flag, "Weeks").otherwise(F.col("time_to_value")).alias("time_to_value"),
        "confidence", "resource_count", "evidence")


def ranked(opportunities: DataFrame) -> DataFrame:
    """By annual savings, ties by lever, cloud and scope."""
    return opportunities.orderBy(F.desc("annual_savings"), "lever_id", "cloud", "scope")


def idle_examples(charges: DataFrame, limit: int | None = None) -> DataFrame:
    """The resource ids of each idle resource type in id order, all or the first `limit`."""
    ids = (charges.filter(_tags()["O03"] & F.col("ResourceId").isNotNull())
           .select("ResourceType", "ResourceId").distinct())
    if limit is not None:  # a row number limit is cut per partition before the shuffle
        first = Window.partitionBy("ResourceType").orderBy("ResourceId")
        ids = ids.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= limit)
    return (ids.groupBy("ResourceType").agg(F.array_sort(F.collect_list("ResourceId")).alias("resource_ids")))


def snapshot(opportunities: DataFrame, as_of, generated_at) -> DataFrame:
    """The rows the nightly job writes: evidence as JSON, snapshot day and time."""
    return opportunities.drop("detector").select(
        F.lit(as_of).cast("date").alias("as_of"), "lever_id", "lever_name", "category", "cloud", "scope",
        F.col("monthly_savings").cast("decimal(28,9)").alias("monthly_savings"),
        F.col("annual_savings").cast("decimal(28,9)").alias("annual_savings"),
        "effort", "risk", "time_to_value", "confidence", F.to_json("evidence").alias("evidence"),
        "resource_count", F.lit(generated_at).cast("timestamp_ntz").alias("_generated_at"))


def filtered(opportunities: DataFrame, category: str | None = None, min_annual: float = 0.0) -> DataFrame:
    if category:
        opportunities = opportunities.filter(F.lower("category") == category.strip().lower())
    return opportunities.filter(F.col("annual_savings") >= min_annual)


def count_and_total(opportunities: DataFrame) -> DataFrame:
    return opportunities.agg(F.count(F.lit(1)).alias("count"),
                             F.round(F.coalesce(F.sum("annual_savings"), F.lit(0.0)), 2).alias("total_annual_savings"))


def usage_waste(opportunities: DataFrame) -> DataFrame:
    """Monthly dollars of the waste levers."""
    waste = F.sum(F.when(F.col("lever_id").isin(WASTE_LEVERS), F.col("monthly_savings")))
    return opportunities.agg(F.coalesce(waste, F.lit(0.0)).alias("usage_waste_monthly"))


#: Detectors that can produce waste levers.
WASTE_DETECTORS = ["O03", "O06"]


def savings_by_category(opportunities: DataFrame) -> DataFrame:
    return opportunities.groupBy("category").agg(
        F.sum("monthly_savings").alias("monthly_savings"), F.sum("annual_savings").alias("annual_savings"),
        F.count(F.lit(1)).alias("opportunities"))


def roadmap(opportunities: DataFrame) -> DataFrame:
    """Execution waves with running annual savings.

    Wave 1: prerequisites and low effort with low risk; wave 2: other low or medium effort;
    wave 3: the rest.
    """
    easy = (F.col("effort") == "Low") & (F.col("risk") == "Low")
    wave = F.when((F.col("monthly_savings") == 0) | easy, 1).when(F.col("effort").isin("Low", "Medium"), 2).otherwise(3)
    run = (Window.partitionBy().orderBy("wave", F.desc("annual_savings"), "lever_id", "cloud", "scope")
           .rowsBetween(Window.unboundedPreceding, 0))
    return opportunities.withColumn("wave", wave).select(
        "wave", "lever_id", F.col("lever_name").alias("lever"), "scope", "cloud", "monthly_savings", "annual_savings",
        "effort", "risk", "time_to_value", "confidence",
        F.sum("annual_savings").over(run).alias("cumulative_annual_savings"))


def esr_uplift(charges: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Savings rate now and after the rate levers; without on-demand spend nothing changes."""
    rate = opportunities.filter("category = 'Rate'").agg(
        F.coalesce(F.sum("monthly_savings"), F.lit(0.0))).scalar()
    # Sums per month first: the months of the frame and the totals come from one report.
    report = charges.groupBy(month().alias("m")).agg(
        F.sum(F.when(usage(), F.col(LIST))).alias("usage_list"), F.sum(F.when(usage(), F.col(COST))).alias("usage_cost"))
    row = report.agg(F.count(F.lit(1)).alias("months"), F.sum("usage_list").alias("usage_list"),
                     F.sum("usage_cost").alias("usage_cost")).withColumn("rate_monthly", rate)
    ode = F.coalesce(F.col("usage_list").cast("double"), F.lit(0.0))
    after = F.greatest(F.coalesce(F.col("usage_cost").cast("double"), F.lit(0.0))
                       - F.col("rate_monthly") * F.greatest("months", F.lit(1)), F.lit(0.0))
    projected = F.when(ode > 0, ratio(ode - after, ode) * 100.0).otherwise(esr_pct())
    return row.select(
        F.round(esr_pct(), 2).alias("current_esr_pct"), F.round(projected, 2).alias("projected_esr_pct"),
        F.when(ode > 0, F.round(projected - esr_pct(), 2)).otherwise(0.0).alias("uplift_pts"),
        F.round(F.col("rate_monthly") * 12.0, 2).alias("rate_savings_annual"))
