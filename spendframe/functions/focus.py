"""The charge schema: FOCUS 1.2 columns, enums, tag keys and aliases.

The column list, enums and aliases below are fixed values: they come from the public
specification and decide which rows validate and where a tag lands.
"""

from __future__ import annotations

from pyspark.sql import types as T

M, C, R = "Mandatory", "Conditional", "Recommended"

# --- fixed values: spec columns (name, feature level, kind, nullable), spec order -------
SPEC = [
    ("BillingAccountId", M, "string", False),
    ("BillingAccountName", M, "string", False),
    ("BillingAccountType", C, "string", True),
    ("BillingCurrency", M, "string", False),
    ("BillingPeriodStart", M, "datetime", False),
    ("BillingPeriodEnd", M, "datetime", False),
    ("InvoiceId", M, "string", True),
    ("InvoiceIssuerName", M, "string", False),
    ("SubAccountId", C, "string", True),
    ("SubAccountName", C, "string", True),
    ("SubAccountType", C, "string", True),
    ("ChargeCategory", M, "string", False),
    ("ChargeClass", M, "string", True),
    ("ChargeDescription", M, "string", False),
    ("ChargeFrequency", R, "string", True),
    ("ChargePeriodStart", M, "datetime", False),
    ("ChargePeriodEnd", M, "datetime", False),
    ("BilledCost", M, "decimal", False),
    ("EffectiveCost", M, "decimal", False),
    ("ListCost", M, "decimal", False),
    ("ContractedCost", M, "decimal", False),
    ("ContractedUnitPrice", C, "decimal", True),
    ("ListUnitPrice", C, "decimal", True),
    ("PricingCategory", C, "string", True),
    ("PricingCurrency", C, "string", True),
    ("PricingCurrencyContractedUnitPrice", C, "decimal", True),
    ("PricingCurrencyEffectiveCost", C, "decimal", True),
    ("PricingCurrencyListUnitPrice", C, "decimal", True),
    ("PricingQuantity", C, "decimal", True),
    ("PricingUnit", C, "string", True),
    ("ConsumedQuantity", C, "decimal", True),
    ("ConsumedUnit", C, "string", True),
    ("CommitmentDiscountCategory", C, "string", True),
    ("CommitmentDiscountId", C, "string", True),
    ("CommitmentDiscountName", C, "string", True),
    ("CommitmentDiscountQuantity", C, "decimal", True),
    ("CommitmentDiscountStatus", C, "string", True),
    ("CommitmentDiscountType", C, "string", True),
    ("CommitmentDiscountUnit", C, "string", True),
    ("CapacityReservationId", C, "string", True),
    ("CapacityReservationStatus", C, "string", True),
    ("ProviderName", M, "string", False),
    ("PublisherName", C, "string", True),
    ("ServiceCategory", M, "string", False),
    ("ServiceName", M, "string", False),
    ("ServiceSubcategory", R, "string", True),
    ("ResourceId", C, "string", True),
    ("ResourceName", C, "string", True),
    ("ResourceType", C, "string", True),
    ("RegionId", C, "string", True),
    ("RegionName", C, "string", True),
    ("AvailabilityZone", R, "string", True),
    ("SkuId", C, "string", True),
    ("SkuMeter", C, "string", True),
    ("SkuPriceDetails", C, "json", True),
    ("SkuPriceId", C, "string", True),
    ("Tags", C, "json", True),
]

# --- fixed values: version 1.3 columns, carried when present, dropped at the sink -------
EXTENSION_COLUMNS = [
    "ServiceProviderName", "HostProviderName", "AllocatedMethodId", "AllocatedMethodDetails",
    "AllocatedResourceId", "AllocatedResourceName", "AllocatedTags", "ContractApplied",
]

# --- fixed values: closed enums --------------------------------------------------------
ENUMS = {
    "ChargeCategory": ["Usage", "Purchase", "Tax", "Credit", "Adjustment"],
    "ChargeClass": ["Correction"],
    "ChargeFrequency": ["One-Time", "Recurring", "Usage-Based"],
    "ServiceCategory": [
        "AI and Machine Learning", "Analytics", "Business Applications", "Compute",
        "Databases", "Developer Tools", "Multicloud", "Identity", "Integration",
        "Internet of Things", "Management and Governance", "Media", "Migration", "Mobile",
        "Networking", "Security", "Storage", "Web", "Other",
    ],
    "PricingCategory": ["Standard", "Dynamic", "Committed", "Other"],
    "CommitmentDiscountCategory": ["Spend", "Usage"],
    "CommitmentDiscountStatus": ["Used", "Unused"],
    "CapacityReservationStatus": ["Used", "Unused"],
}

# --- fixed values: subcategories per category; "Other (<category>)" is added by rule ----
_NAMED_SUBCATEGORIES = {
    "AI and Machine Learning": ["AI Platforms", "Bots", "Generative AI", "Machine Learning",
                                "Natural Language Processing"],
    "Analytics": ["Analytics Platforms", "Business Intelligence", "Data Processing", "Search",
                  "Streaming Analytics"],
    "Business Applications": ["Productivity and Collaboration"],
    "Compute": ["Containers", "End User Computing", "Quantum Compute", "Serverless Compute",
                "Virtual Machines"],
    "Databases": ["Caching", "Data Warehouses", "Ledger Databases", "NoSQL Databases",
                  "Relational Databases", "Time Series Databases"],
    "Developer Tools": ["Developer Platforms", "Continuous Integration and Deployment",
                        "Development Environments", "Source Code Management",
                        "Quality Assurance"],
    "Identity": ["Identity and Access Management"],
    "Integration": ["API Management", "Messaging", "Workflow Orchestration"],
    "Internet of Things": ["IoT Analytics", "IoT Platforms"],
    "Management and Governance": ["Architecture", "Compliance", "Cost Management",
                                  "Data Governance", "Disaster Recovery",
                                  "Endpoint Management", "Observability", "Support"],
    "Media": ["Content Creation", "Gaming", "Media Streaming", "Mixed Reality"],
    "Migration": ["Data Migration", "Resource Migration"],
    "Multicloud": ["Multicloud Integration"],
    "Networking": ["Application Networking", "Content Delivery", "Network Connectivity",
                   "Network Infrastructure", "Network Routing", "Network Security"],
    "Security": ["Secret Management", "Security Posture Management",
                 "Threat Detection and Response"],
    "Storage": ["Backup Storage", "Block Storage", "File Storage", "Object Storage",
                "Storage Platforms"],
    "Web": ["Application Platforms"],
}
SUBCATEGORIES = {
    category: _NAMED_SUBCATEGORIES.get(category, []) + [f"Other ({category})"]
    for category in ENUMS["ServiceCategory"]
}

# --- fixed values: tag keys and the spellings folded onto them -------------------------
CANONICAL_TAGS = ["application", "business_unit", "cost_center", "environment", "owner", "project"]
TAG_ALIASES = {
    "application": ["app", "appname", "app_name", "application_name", "service", "workload"],
    "business_unit": ["bu", "businessunit", "business-unit", "division", "org", "department"],
    "cost_center": ["costcenter", "cost-center", "cc", "costcentre", "gl_code", "glcode"],
    "environment": ["env", "envt", "stage", "tier", "lifecycle"],
    "owner": ["owned_by", "ownedby", "contact", "team_email", "technical_owner"],
    "project": ["proj", "program", "initiative", "product"],
}
UNALLOCATED = "Unallocated"

# --- fixed values: column spellings of other spec versions -----------------------------
COLUMN_ALIASES = {
    "ServiceProviderName": "ProviderName",
    "HostProviderName": "PublisherName",
    "AmortizedCost": "EffectiveCost",
    "ChargeType": "ChargeCategory",
    "UsageQuantity": "ConsumedQuantity",
    "UsageUnit": "ConsumedUnit",
}

# --- fixed values: categories a commitment discount can cover --------------------------
COMMITMENT_ELIGIBLE = ["Compute", "Databases", "AI and Machine Learning", "Analytics"]

COLUMNS = [name for name, *_ in SPEC]
KIND = {name: kind for name, _, kind, _ in SPEC}
MANDATORY = [name for name, level, _, _ in SPEC if level == M]
NOT_NULLABLE = [name for name, level, _, nullable in SPEC if level == M and not nullable]
RECOMMENDED = [name for name, level, _, _ in SPEC if level == R]
TAG_COLUMNS = [f"tag_{tag}" for tag in CANONICAL_TAGS]

#: Money and quantities rest as decimals, so sums are exact and order-free.
SPARK_TYPE = {
    "string": T.StringType(),
    "json": T.StringType(),
    "decimal": T.DecimalType(28, 9),
    "datetime": T.TimestampNTZType(),
}


def spec_schema() -> T.StructType:
    """The 57 spec columns; feature level and kind travel as field metadata."""
    return T.StructType([
        T.StructField(name, SPARK_TYPE[kind], nullable, {"level": level, "kind": kind})
        for name, level, kind, nullable in SPEC
    ])


def warehouse_schema() -> T.StructType:
    """The table at rest: spec columns, tag columns, provenance."""
    schema = spec_schema()
    for tag in TAG_COLUMNS:
        schema = schema.add(tag, T.StringType(), False)
    return schema.add("_ingested_at", T.TimestampNTZType(), False).add("_binding", T.StringType(), True)
