"""Charges derived from the order tables (the mapping stated in FIXTURES.md).

The same text runs in Spark and in the SQL oracle. Money comes from integer cents, so every
sum is exact and independent of row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CHARGES_SQL = """
WITH b AS (
  SELECT l_orderkey * 8 + l_linenumber AS k,
         CAST(l_shipdate AS DATE) AS d,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS m,
         (2001 - extract(year FROM l_shipdate)) * 12 + (9 - extract(month FROM l_shipdate)) AS ago,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(round(l_discount * 100) AS BIGINT) AS disc,
         CAST(l_quantity AS BIGINT) AS qty,
         l_suppkey, l_partkey, l_returnflag, o_orderpriority, o_custkey,
         p_brand, p_type, p_size, c_custkey, c_mktsegment
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
), e AS (
  SELECT b.*,
    CASE l_suppkey % 5 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Azure' WHEN 2 THEN 'GCP'
                       WHEN 3 THEN 'OCI' ELSE 'IBM Cloud' END AS ProviderName,
    CASE WHEN p_brand = 'Brand#1' THEN 'Management and Governance'
         WHEN p_brand = 'Brand#2' THEN 'Security'
         WHEN p_type = 'STANDARD' THEN 'Compute'
         WHEN p_type = 'SMALL' THEN 'Storage'
         WHEN p_type = 'LARGE' THEN 'Databases'
         WHEN p_type = 'PROMO' THEN 'AI and Machine Learning'
         WHEN p_type = 'ECONOMY' THEN 'Networking'
         ELSE 'Analytics' END AS ServiceCategory,
    CASE k % 97 WHEN 0 THEN 'Purchase' WHEN 1 THEN 'Tax' WHEN 2 THEN 'Credit'
                ELSE 'Usage' END AS ChargeCategory
  FROM b
), f AS (
  SELECT e.*,
    (ChargeCategory = 'Usage' AND l_returnflag = 'R' AND ServiceCategory IN
      ('Compute', 'Databases', 'AI and Machine Learning', 'Analytics')) AS cm,
    CASE WHEN ServiceCategory = 'AI and Machine Learning'
         THEN least(100, 4 + 28 * greatest(0, 3 - ago)) ELSE 100 END AS ramp,
    CASE WHEN k % 11 = 0 THEN 'Unallocated'
         WHEN c_custkey % 12 = 0 THEN 'Shared Platform Services'
         ELSE 'app-' || CAST(c_custkey % 12 AS STRING) END AS app,
    CASE WHEN k % 11 = 0 THEN 'Unallocated' ELSE c_mktsegment END AS bu,
    CASE WHEN k % 11 = 0 THEN 'Unallocated'
         WHEN o_custkey % 3 = 0 THEN 'prod' WHEN o_custkey % 3 = 1 THEN 'nonprod'
         ELSE 'dr' END AS env
  FROM e
)
SELECT
  k AS charge_key, ProviderName, ServiceCategory, ChargeCategory,
  ServiceCategory || ' ' || CAST(l_partkey % 3 AS STRING) AS ServiceName,
  CASE WHEN ChargeCategory = 'Usage' THEN 'region-' || CAST(l_suppkey % 2 AS STRING) END AS RegionId,
  CASE WHEN ChargeCategory = 'Usage' THEN 'acct-' || CAST(l_suppkey % 10 AS STRING) END AS SubAccountId,
  CASE WHEN ago >= 12 THEN m ELSE d END AS ChargePeriodStart,
  CAST(CASE WHEN ago >= 12 THEN m + INTERVAL 1 MONTH ELSE d + INTERVAL 1 DAY END AS DATE) AS ChargePeriodEnd,
  CAST(CASE WHEN cm AND qty <= 3 THEN 0 ELSE cents * 100 * ramp END AS DECIMAL(18,0))
    * CAST(0.000001 AS DECIMAL(7,6)) AS ListCost,
  CAST(CASE WHEN ChargeCategory = 'Purchase' THEN 0
            WHEN ChargeCategory = 'Credit' THEN -cents * 200
            ELSE cents * (100 - disc) * ramp END AS DECIMAL(18,0))
    * CAST(0.000001 AS DECIMAL(7,6)) AS EffectiveCost,
  CASE WHEN cm OR ChargeCategory = 'Purchase' THEN 'cmt-' || ProviderName END AS CommitmentDiscountId,
  CASE WHEN cm THEN CASE WHEN qty <= 3 THEN 'Unused' ELSE 'Used' END END AS CommitmentDiscountStatus,
  CASE WHEN ChargeCategory = 'Tax' THEN NULL
       WHEN cm OR ChargeCategory = 'Purchase' THEN 'Committed'
       WHEN o_orderpriority = '5-LOW' THEN 'Dynamic'
       WHEN o_orderpriority = '4-NOT SPECIFIED' AND k % 2 = 0 THEN NULL
       ELSE 'Standard' END AS PricingCategory,
  CAST(CASE WHEN ChargeCategory <> 'Usage' OR (cm AND qty <= 3) OR k % 50 = 3
            THEN 0 ELSE qty * 20 END AS DOUBLE) AS ConsumedQuantity,
  CASE WHEN k % 50 = 3 THEN
         CASE l_partkey % 5 WHEN 0 THEN 'Volume' WHEN 1 THEN 'LoadBalancer'
              WHEN 2 THEN 'IpAddress' WHEN 3 THEN 'Gateway' ELSE 'Snapshot' END
       WHEN ServiceCategory = 'Storage' THEN 'Volume' ELSE 'Instance' END AS ResourceType,
  CASE WHEN ChargeCategory = 'Usage' THEN
       ProviderName || '-' || ServiceCategory || '-' || CAST(l_partkey % 40 AS STRING) END AS ResourceId,
  CASE WHEN ServiceCategory = 'Storage' THEN CASE WHEN p_size % 3 = 0 THEN 'gp2' ELSE 'gp3' END
       WHEN ServiceCategory = 'Compute' THEN
         CASE p_size % 6 WHEN 0 THEN 'm4.xlarge' WHEN 1 THEN 'm7g.xlarge'
              WHEN 2 THEN 'Standard_D2_v2' WHEN 3 THEN 'n1-standard-4'
              WHEN 4 THEN 'VM.Standard.A1.Flex' ELSE 'VM.Standard.E5.Flex' END
         || CASE WHEN l_partkey % 7 = 0 THEN ':license-included' ELSE '' END
       END AS SkuId,
  CASE WHEN k % 22 = 0 THEN 'not json' WHEN k % 11 = 0 THEN '{}'
       ELSE '{"' || CASE k % 3 WHEN 0 THEN 'application' WHEN 1 THEN 'App' ELSE 'app-name' END
            || '": "' || app || '", "BU": "' || bu || '", "env": "' || env || '"}' END AS Tags,
  app AS tag_application, bu AS tag_business_unit, env AS tag_environment
FROM f
"""

#: A feed with planted defects, none of them for AWS. `{charges}` is the table above.
FEED_SQL = """
SELECT c.*,
  c.ProviderName AS _binding,
  'acct' AS BillingAccountId, 'Account' AS BillingAccountName, 'USD' AS BillingCurrency,
  CAST(date_trunc('month', c.ChargePeriodStart) AS DATE) AS BillingPeriodStart,
  CAST(date_trunc('month', c.ChargePeriodStart) + INTERVAL 1 MONTH AS DATE) AS BillingPeriodEnd,
  CASE WHEN c.ProviderName = 'AWS' OR c.charge_key % 50 <> 7 THEN 'Issuer' END AS InvoiceIssuerName,
  'usage' AS ChargeDescription, c.EffectiveCost AS BilledCost, c.EffectiveCost AS ContractedCost,
  CASE WHEN c.ProviderName <> 'AWS' AND c.charge_key % 77 = 0 THEN 'Oops' || CAST(c.charge_key % 9 AS STRING)
       END AS ChargeClass,
  CASE WHEN c.ProviderName = 'GCP' THEN NULL
       WHEN c.ChargeCategory = 'Purchase' AND c.ProviderName <> 'AWS' THEN 'Usage-Based'
       WHEN c.ChargeCategory = 'Usage' THEN 'Usage-Based' ELSE 'One-Time' END AS ChargeFrequency,
  CASE WHEN c.CommitmentDiscountId IS NOT NULL AND (c.ProviderName = 'AWS' OR c.charge_key % 4 <> 1)
       THEN 'Savings Plan' END AS CommitmentDiscountType,
  CASE WHEN c.ServiceCategory = 'Compute' THEN 'Virtual Machines'
       WHEN c.ServiceCategory = 'Storage' AND c.ProviderName <> 'AWS' AND c.charge_key % 2 = 0 THEN 'Virtual Machines'
       WHEN c.ServiceCategory = 'Storage' THEN 'Object Storage'
       WHEN c.ServiceCategory = 'Databases' AND c.ProviderName = 'OCI' THEN 'Search'
       END AS ServiceSubcategory
FROM {charges} c
"""

TABLES = ("lineitem", "orders", "part", "customer")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole charge estate. Joins carry no hints: table sizes decide the strategy."""
    for table in TABLES:
        read(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(CHARGES_SQL)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges as a billing feed with defects, for the validation operators."""
    charges(spark, sf_dir).createOrReplaceTempView("feed_charges")
    return spark.sql(FEED_SQL.replace("{charges}", "feed_charges"))


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period, metric, value): distinct orders per month, in long form."""
    orders = read(spark, sf_dir, "orders")
    return (orders.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"))
            .agg(F.count_distinct("o_orderkey").cast("double").alias("value"))
            .select("period", F.lit("orders").alias("metric"), "value"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second day-grain feed: value per day and event type."""
    return (read(spark, sf_dir, "events")
            .groupBy(F.col("ts").cast("date").alias("period"), "event_type")
            .agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("cost")))
