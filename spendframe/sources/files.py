"""File feeds: canonical CSV or Parquet, cloud exports, gzipped daily reports."""

from __future__ import annotations

import csv
import datetime as dt
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from spendframe.operators import normalize as nz
from spendframe.sources import peek

# --- fixed values: provider spellings folded to OCI -----------------------------------------
OCI_NAMES = ["oci", "oracle", "oracle cloud", "oracle cloud infrastructure"]
OCI_PREFIX = "FOCUS Reports"


def file_format(path: str, explicit: str | None = None) -> str:
    """Format from the option, else the extension, else CSV."""
    if explicit:
        return explicit.lower().lstrip(".")
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return "parquet" if extension in ("parquet", "pq", "parq") else "csv"


def read_raw(spark: SparkSession, path: str | list[str], fmt: str | None = None) -> DataFrame:
    """The feed as it is. CSV stays text (no inference pass); types come with `normalize`."""
    paths = [path] if isinstance(path, str) else path
    if file_format(paths[0], fmt) == "parquet":
        return spark.read.option("mergeSchema", True).parquet(*paths)
    return csv_by_name(spark, paths)


def _data_files(spark: SparkSession, glob: str) -> list[str]:
    """The files a path or glob stands for, folders included; hidden ones are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, waiting = [], list(system.globStatus(path) or [])
    while waiting:
        status = waiting.pop()
        if status.getPath().getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            waiting += list(system.listStatus(status.getPath()))
        elif status.getLen():
            out.append(status.getPath().toString())
    return sorted(out)


def _uri(spark: SparkSession, file: str) -> str:
    return spark._jvm.org.apache.hadoop.fs.Path(file).toUri().toString()


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The column names in a file's first line, read by the driver: for file systems that Arrow does not know."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        text = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        line = jvm.java.io.BufferedReader(text).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").lstrip("\ufeff")]), []))


def csv_by_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with columns matched by name: one read for each distinct header (read in tasks), then a union by name.

    A file that lacks a column has nulls in it. Spark checks every file against its header, so columns can't be
    taken by position. A gzipped file is one task; uncompressed ones are split.
    """
    files = [f for path in paths for f in _data_files(spark, path)]
    if not files:
        raise FileNotFoundError(f"no files under {', '.join(paths)}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, peek.first_lines(spark, [_uri(spark, f) for f in files])):
        header = _header(spark, file) if line is None else tuple(next(csv.reader([line]), []))
        groups.setdefault(header, []).append(file)
    reader = spark.read.option("header", True).option("multiLine", False).option("enforceSchema", False)
    parts = [reader.schema(", ".join(f"`{name}` string" for name in header)).csv(found) for header, found in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def date_range(df: DataFrame, start: dt.date, end: dt.date, guard: bool = True) -> DataFrame:
    """Half-open `[start, end)` on the charge-period start; the bound can be pushed to the scan.

    With `guard`, a feed without a single readable date passes whole, so validation reports it
    instead of it vanishing. Finding that out stops at the first readable date.
    """
    period = F.col("ChargePeriodStart")
    if guard and not df.select(period.alias("p")).filter("p is not null").take(1):
        return df
    return df.filter((period >= F.lit(start)) & (period < F.lit(end)))


def bounded(raw: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The typed dates of a raw feed bound before anything else; text dates wait for the cast."""
    kinds = dict(raw.dtypes)
    if kinds.get("ChargePeriodStart", "string") in ("date", "timestamp", "timestamp_ntz"):
        return date_range(raw, start, end, guard=False)
    return raw


_PERIOD = re.compile(r"=(\d{4})-(\d{2})(?:-\d{2})?$")


def period_folders(spark: SparkSession, root: str, start: dt.date, end: dt.date) -> list[str] | None:
    """The billing-period folders (`name=YYYY-MM`) of the window; None for an export without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    months = {f.getPath().toString(): _PERIOD.search(f.getPath().getName()) for f in found if f.isDirectory()}
    if not months or not all(months.values()):
        return None
    low, high = start.year * 12 + start.month, (end - dt.timedelta(days=1)).year * 12 + (end - dt.timedelta(days=1)).month
    return sorted(f for f, m in months.items() if low <= int(m[1]) * 12 + int(m[2]) <= high)


def focus_file(spark: SparkSession, path: str, start: dt.date, end: dt.date, vendor: str = "FOCUS file",
               fmt: str | None = None) -> DataFrame:
    """A canonical export in one file or folder."""
    raw = read_raw(spark, path, fmt)
    known = peek.all_null(raw, ["InvoiceIssuerName"]) if file_format(path, fmt) == "parquet" else {}
    return nz.stamp_issuer(date_range(nz.normalize(raw), start, end), vendor, raw, known)


def cloud_export(spark: SparkSession, path: str, start: dt.date, end: dt.date, provider: str, vendor: str,
                 fmt: str | None = None) -> DataFrame:
    """A cloud's own export: `x_*` extensions dropped, provider filled in when wholly absent.

    Only the window's billing-period folders are listed, and typed dates are bound at the scan. Whether
    issuer and provider are absent is asked of the footers; only where these leave it open, of the bounded rows.
    """
    folders = period_folders(spark, path, start, end) if file_format(path, fmt) == "parquet" else None
    if folders is not None and not folders:
        return nz.normalize(spark.createDataFrame([], "ProviderName string"))
    raw = read_raw(spark, path if folders is None else folders, fmt)
    raw = bounded(raw.drop(*[c for c in raw.columns if c.lower().startswith("x_")]), start, end)
    out = date_range(nz.normalize(raw), start, end, guard=False)
    values = {"InvoiceIssuerName": vendor, "ProviderName": provider}
    known = peek.all_null(raw, list(values)) if file_format(path, fmt) == "parquet" else {}
    return nz.fill_all_null(out, values, raw, known)


def aws_export(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    return cloud_export(spark, path, start, end, "AWS", "Amazon Web Services", "parquet")


def azure_export(spark: SparkSession, path: str, start: dt.date, end: dt.date, fmt: str | None = None) -> DataFrame:
    return cloud_export(spark, path, start, end, "Azure", "Microsoft", fmt)


def gcp_export(table: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A canonical billing table; the range reaches the scan before anything else."""
    raw = date_range(table, start, end, guard=False)
    return nz.fill_all_null(nz.normalize(raw), {"InvoiceIssuerName": "Google Cloud", "ProviderName": "GCP"}, raw)


def month_globs(root: str, start: dt.date, end: dt.date) -> list[str]:
    """One glob per month the window touches, never the bare prefix."""
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [f"{root}/{OCI_PREFIX}/{m // 12:04d}/{m % 12 + 1:02d}/*/*.csv.gz" for m in range(first, last + 1)]


def report_files(spark: SparkSession, root: str, start: dt.date, end: dt.date) -> list[str]:
    """The daily reports of `[start, end)`, by the day in their path; months without one are skipped."""
    found = [f for glob in month_globs(root, start, end) for f in _data_files(spark, glob)]
    days = {f: re.search(r"/(\d{4})/(\d{2})/(\d{2})/[^/]*$", f) for f in found}
    return [f for f, day in days.items() if day and start <= dt.date(*map(int, day.groups())) < end]


def oci_reports(spark: SparkSession, root: str, start: dt.date, end: dt.date) -> DataFrame:
    """Gzipped daily reports of the window, columns by name; provider spellings folded to OCI."""
    present = report_files(spark, root, start, end)
    if not present:
        return nz.normalize(spark.createDataFrame([], "ProviderName string"))
    raw = csv_by_name(spark, present)
    if "ProviderName" in raw.columns:
        known = F.lower(F.trim("ProviderName")).isin(OCI_NAMES)
        raw = raw.withColumn("ProviderName", F.when(known, "OCI").otherwise(F.col("ProviderName")))
    else:
        raw = raw.withColumn("ProviderName", F.lit("OCI"))
    return nz.stamp_issuer(nz.normalize(raw), "Oracle", raw)


def month_slices(ranges: DataFrame) -> DataFrame:
    """`[start, end)` per row into calendar-month slices, clipped at both ends."""
    first = F.explode(F.sequence(F.trunc("start", "month"), F.trunc(F.date_sub("end", 1), "month"),
                                 F.expr("INTERVAL 1 MONTH"))).alias("m")
    return ranges.filter(F.col("start") < F.col("end")).select("*", first).select(
        *[c for c in ranges.columns if c not in ("start", "end")],
        F.greatest("start", "m").alias("lo"), F.least(F.add_months("m", 1), F.col("end")).alias("hi"))


def date_chunks(start: dt.date, end: dt.date, max_days: int) -> list[tuple[dt.date, dt.date]]:
    """`[start, end)` in chunks of at most `max_days`, for selecting landed files."""
    count = -(-(end - start).days // max_days)
    step = dt.timedelta(days=max_days)
    return [(start + i * step, min(start + (i + 1) * step, end)) for i in range(max(count, 0))]
