"""The savings-lever catalogue and per-cloud profiles: small static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ALL = "AWS, Azure, GCP, OCI"

# --- fixed values: id, name, category, clouds, savings low, high, effort, risk, time to value
LEVERS = [
    ("R1", "AWS Compute Savings Plan", "Rate", "AWS", 0.10, 0.66, "Low", "Low", "Days"),
    ("R2", "AWS EC2 Instance Savings Plan", "Rate", "AWS", 0.10, 0.72, "Low", "Medium", "Days"),
    ("R3", "AWS Reserved Instance (Standard)", "Rate", "AWS", 0.10, 0.72, "Low", "Medium", "Days"),
    ("R4", "AWS Convertible RI", "Rate", "AWS", 0.10, 0.66, "Low", "Low", "Days"),
    ("R5", "Azure Reservations", "Rate", "Azure", 0.10, 0.72, "Low", "Medium", "Days"),
    ("R6", "Azure Savings Plan for Compute", "Rate", "Azure", 0.10, 0.65, "Low", "Low", "Days"),
    ("R7", "GCP Flexible (spend-based) CUD", "Rate", "GCP", 0.28, 0.46, "Low", "Low", "Days"),
    ("R8", "GCP Resource-based CUD", "Rate", "GCP", 0.37, 0.70, "Low", "Medium", "Days"),
    ("R9", "Spot / Preemptible / Azure Spot", "Rate", ALL, 0.60, 0.91, "Medium", "High", "Days"),
    ("R10", "EDP / MACC / Google commit", "Rate", ALL, 0.10, 0.35, "High", "Low", "Months"),
    ("R11", "Azure Hybrid Benefit", "Rate", "Azure", 0.30, 0.76, "Low", "Low", "Hours"),
    ("R12", "BYOL / licence mobility", "Rate", ALL, 0.20, 0.50, "Medium", "Medium", "Weeks"),
    ("R13", "Windows -> Linux migration", "Rate", ALL, 0.20, 0.40, "High", "Medium", "Months"),
    ("R14", "AWS Graviton / ARM", "Rate", "AWS", 0.10, 0.40, "Medium", "Medium", "Weeks"),
    ("R15", "Azure Cobalt / Ampere ARM", "Rate", "Azure", 0.10, 0.40, "Medium", "Medium", "Weeks"),
    ("R16", "GCP Axion (C4A) / Tau", "Rate", "GCP", 0.10, 0.40, "Medium", "Medium", "Weeks"),
    ("R17", "OCI Annual Universal Credits", "Rate", "OCI", 0.10, 0.30, "Low", "Low", "Weeks"),
    ("R18", "OCI Ampere A1 (Arm) Compute", "Rate", "OCI", 0.10, 0.40, "Medium", "Medium", "Weeks"),
    ("R19", "Oracle Support Rewards", "Rate", "OCI", 0.25, 0.33, "Low", "Low", "Months"),
    ("R20", "BYOL to OCI for Oracle Database", "Rate", "OCI", 0.30, 0.76, "Low", "Low", "Hours"),
    ("R21", "Commitment utilization & re-shape", "Rate", ALL, 0.00, 1.00, "Medium", "Low", "Weeks"),
    ("U1", "Compute rightsizing", "Usage", ALL, 0.20, 0.40, "Medium", "Medium", "Days"),
    ("U2", "RDS / Azure SQL / Cloud SQL rightsizing", "Usage", ALL, 0.20, 0.40, "Medium", "Medium", "Days"),
    ("U3", "K8s requests/limits + bin-packing", "Usage", ALL, 0.20, 0.40, "Medium", "Medium", "Weeks"),
    ("U4", "Unattached EBS / managed disks", "Usage", ALL, 0.90, 1.00, "Low", "Low", "Hours"),
    ("U5", "Idle load balancers", "Usage", ALL, 0.90, 1.00, "Low", "Low", "Hours"),
    ("U6", "Unused Elastic / Public IPs", "Usage", ALL, 0.90, 1.00, "Low", "Low", "Hours"),
    ("U7", "Idle NAT gateways", "Usage", ALL, 0.90, 1.00, "Low", "Low", "Hours"),
    ("U8", "Orphaned snapshots / lifecycle", "Usage", ALL, 0.90, 1.00, "Low", "Low", "Hours"),
    ("U9", "Stopped-but-billed resources", "Usage", ALL, 0.50, 1.00, "Low", "Low", "Hours"),
    ("U10", "Schedule / park non-prod", "Usage", ALL, 0.60, 0.70, "Low", "Low", "Days"),
    ("U11", "Autoscaling / consolidation", "Usage", ALL, 0.15, 0.35, "Medium", "Medium", "Weeks"),
    ("U12", "S3 Intelligent-Tiering / lifecycle", "Usage", "AWS", 0.40, 0.68, "Low", "Low", "Days"),
    ("U13", "Azure Blob Cool / Cold / Archive", "Usage", "Azure", 0.30, 0.55, "Low", "Low", "Days"),
    ("U14", "GCS Nearline / Coldline / Archive / Autoclass", "Usage", "GCP", 0.30, 0.50, "Low", "Low", "Days"),
    ("U15", "gp2 -> gp3 EBS", "Usage", "AWS", 0.15, 0.20, "Low", "Low", "Hours"),
    ("U16", "Over-provisioned IOPS / throughput", "Usage", ALL, 0.15, 0.40, "Low", "Medium", "Days"),
    ("U17", "Previous-generation instance families", "Usage", ALL, 0.10, 0.15, "Low", "Low", "Days"),
    ("U18", "CloudWatch / Log Analytics retention", "Usage", ALL, 0.20, 0.50, "Low", "Low", "Hours"),
    ("U19", "Data-transfer / egress", "Usage", ALL, 0.20, 0.60, "Medium", "Medium", "Weeks"),
    ("U20", "Lambda power tuning", "Usage", "AWS", 0.30, 0.40, "Low", "Low", "Hours"),
    ("U21", "OCI Object Storage Infrequent Access / Archive", "Usage", "OCI", 0.30, 0.50, "Low", "Low", "Days"),
    ("C1", "Provisioned -> serverless DB", "Architecture", ALL, 0.30, 0.90, "High", "Medium", "Months"),
    ("C2", "Serverless vs always-on compute", "Architecture", ALL, 0.30, 0.80, "High", "Medium", "Months"),
    ("C3", "Managed-service consolidation", "Architecture", ALL, 0.15, 0.40, "High", "Medium", "Months"),
    ("C4", "Caching / CDN", "Architecture", ALL, 0.20, 0.60, "Medium", "Low", "Weeks"),
    ("C5", "Multi-tenancy / pooling", "Architecture", ALL, 0.20, 0.50, "High", "High", "Months"),
    ("C6", "Data lifecycle / retention policy", "Architecture", ALL, 0.15, 0.40, "Low", "Low", "Weeks"),
    ("C7", "Region choice", "Architecture", ALL, 0.10, 0.30, "High", "Medium", "Months"),
    ("G1", "GPU rightsizing", "AI/GPU", ALL, 0.20, 0.50, "Medium", "Medium", "Days"),
    ("G2", "Inference batching (vLLM / TensorRT-LLM)", "AI/GPU", ALL, 0.30, 0.90, "Medium", "Medium", "Weeks"),
    ("G3", "Model routing (small-model-first)", "AI/GPU", ALL, 0.30, 0.60, "Medium", "Low", "Weeks"),
    ("G4", "Prompt / context caching", "AI/GPU", ALL, 0.50, 0.90, "Low", "Low", "Days"),
    ("G5", "Token / thinking budgets", "AI/GPU", ALL, 0.15, 0.40, "Low", "Low", "Days"),
    ("G6", "Spot GPU", "AI/GPU", ALL, 0.60, 0.90, "Medium", "High", "Days"),
    ("G7", "Reserved GPU capacity", "AI/GPU", ALL, 0.20, 0.60, "Medium", "Low", "Weeks"),
    ("G8", "SageMaker Savings Plans", "AI/GPU", "AWS", 0.20, 0.64, "Low", "Low", "Days"),
    ("G9", "Bedrock Provisioned Throughput vs On-Demand", "AI/GPU", "AWS", 0.40, 0.60, "Medium", "Low", "Weeks"),
    ("G10", "Batch inference API", "AI/GPU", ALL, 0.50, 0.50, "Low", "Low", "Days"),
]

# --- fixed values: cloud -> commitment rate, commitment lever, spot discount, ARM lever, tier lever
PROFILES = {
    "AWS": (0.31, "R1", 0.72, "R14", "U12"),
    "Azure": (0.34, "R5", 0.68, "R15", "U13"),
    "GCP": (0.28, "R7", 0.75, "R16", "U14"),
    "OCI": (0.25, "R17", 0.50, "R18", "U21"),
}

SCHEMA = ("id string, name string, category string, clouds string, savings_low double, savings_high double, "
          "effort string, risk string, time_to_value string")


def catalog(spark: SparkSession, details: DataFrame | None = None) -> DataFrame:
    """The catalogue. `details` (id, prerequisites, detection, source_url, ...) adds the
    descriptive columns an organisation keeps about its levers."""
    levers = spark.createDataFrame(LEVERS, SCHEMA)
    return levers if details is None else levers.join(details, "id", "left")


def lookup(spark: SparkSession, lever_id: str, details: DataFrame | None = None) -> DataFrame:
    """One lever by id, whatever its case; no row when unknown."""
    return catalog(spark, details).filter(F.col("id") == lever_id.strip().upper())
