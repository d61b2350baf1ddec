"""Reads of the partitioned charge table and the opportunity snapshots.

The charge table is Parquet partitioned by `charge_date` and `_binding`. Every read bounds
`charge_date`, next to the same bound on `ChargePeriodStart`, as one is not derived from the
other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from spendframe.functions import focus
from spendframe.operators.scope import Scope, months_back
from spendframe.plans import sinks

SNAPSHOT_WINDOW_MONTHS = 24
SNAPSHOT_SCHEMA = (
    "lever_id string, lever_name string, category string, cloud string, scope string, monthly_savings decimal(28,9), "
    "annual_savings decimal(28,9), effort string, risk string, time_to_value string, confidence double, evidence string, "
    "resource_count bigint, _generated_at timestamp_ntz, as_of date")


def table(spark: SparkSession, path: str) -> DataFrame:
    """The whole table with its declared types (partition values are not guessed)."""
    return sinks.read_table(spark, path, focus.warehouse_schema().add("charge_date", "date"), "charge_date", "_binding")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All opportunity snapshots."""
    return sinks.read_table(spark, path, SNAPSHOT_SCHEMA, "as_of")


def read_charges(spark: SparkSession, path: str, scope: Scope, today: dt.date,
                 max_bytes: int | None = None) -> DataFrame:
    """Charges of a scope; without a start, the trailing 25 months."""
    scope = scope.bounded(today)
    rows = table(spark, path).filter(F.col("charge_date") >= F.lit(scope.start))
    if scope.end:
        rows = rows.filter(F.col("charge_date") <= F.lit(scope.end))
    rows = scope.apply(rows)
    return rows if max_bytes is None else guard(rows, max_bytes)


def opportunity_window(spark: SparkSession, path: str, today: dt.date) -> DataFrame:
    return read_charges(spark, path, Scope(start=months_back(today, SNAPSHOT_WINDOW_MONTHS)), today)


def scanned_bytes(df: DataFrame) -> int:
    """Size of what the planned scans cover: pruned files, or the estimate of a version 2 source.

    A scan of unknown size is an error, so that a cap can't be passed by not being measured.
    """
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    total = 0
    for scan in [leaves.apply(i) for i in range(leaves.size())]:
        kind = scan.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            total += int(str(scan.selectedPartitions().totalFileSize()))
        elif kind == "BatchScanExec" and scan.scan().estimateStatistics().sizeInBytes().isPresent():
            total += int(scan.scan().estimateStatistics().sizeInBytes().getAsLong())
        elif kind not in ("LocalTableScanExec", "EmptyRelationExec", "OneRowRelationExec"):
            raise ValueError(f"a scan of unknown size: {kind}")
    return total


def guard(df: DataFrame, max_bytes: int) -> DataFrame:
    """Refuse a read above the cap before anything runs."""
    size = scanned_bytes(df)
    if size > max_bytes:
        raise ValueError(f"the scan covers {size} bytes, more than the {max_bytes} allowed")
    return df


def latest(rows: DataFrame, clouds: tuple[str, ...] = ()) -> DataFrame:
    """Snapshot rows of the newest `as_of`, largest annual savings first.

    A cloud matches when it is one of the names in the row's label.
    """
    newest = rows.agg(F.max("as_of")).scalar()
    rows = rows.filter(F.col("as_of") == newest)
    if clouds:
        named = F.transform(F.split("cloud", ","), lambda c: F.trim(c))
        rows = rows.filter(F.arrays_overlap(named, F.array(*[F.lit(c) for c in clouds])))
    return rows.orderBy(F.desc("annual_savings"), "lever_id", "cloud", "scope")


def latest_snapshot(spark: SparkSession, path: str, clouds: tuple[str, ...] = ()) -> DataFrame:
    return latest(snapshots(spark, path), clouds)
