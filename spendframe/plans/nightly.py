"""The two nightly jobs: ingest of all bindings, and the opportunity snapshot."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from spendframe.functions.columns import month
from spendframe.operators import normalize as nz, optimize, validate
from spendframe.plans import sinks
from spendframe.sources import warehouse

LOOKBACK_MONTHS = 2
#: Bindings read at the same time.
AT_ONCE = 4

#: A binding's feed for `[start, end)`.
Feed = Callable[[SparkSession, dt.date, dt.date], DataFrame]


@dataclass(frozen=True)
class BindingResult:
    """loaded, empty or failed; only failures count against a run."""

    binding: str
    status: str
    rows: int = 0
    reason: str = ""


def lookback(today: dt.date, months: int = LOOKBACK_MONTHS) -> tuple[dt.date, dt.date]:
    """First of the month `months` back to today: late and corrected rows are pulled again."""
    index = today.year * 12 + today.month - 1 - months
    return dt.date(index // 12, index % 12 + 1, 1), today


def prepare(feed: DataFrame, binding: str, ingested_at: dt.datetime) -> DataFrame:
    """One binding's feed in warehouse shape."""
    rows = nz.serialize_tags(nz.explode_tags(nz.normalize(feed)))
    return sinks.typed(rows.withColumn("_ingested_at", F.lit(ingested_at)).withColumn("_binding", F.lit(binding)))


def reasons(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The findings of each binding as text, all or the first `most`.

    Findings are per rule and month, so the list per binding is short whatever the row count.
    """
    found = validate.issues(rows.withColumn("month", month()), ["_binding", "month"]).filter("severity = 'error'")
    text = F.concat_ws(" ", F.col("month").cast("string"), "rule", "column", F.col("n").cast("string"))
    listed = F.array_sort(F.collect_set(text))
    return found.groupBy("_binding").agg(F.array_join(listed if most is None else F.slice(listed, 1, most), "; ").alias("reason"))


def _landed(spark: SparkSession, name: str, feed: Feed, folder: str, start: dt.date, end: dt.date, now: dt.datetime) -> str | None:
    """Read one binding and write its landing files; the reason if that fails, whenever it does."""
    try:
        sinks.write_landing(prepare(feed(spark, start, end), name, now), folder)
    except Exception as error:  # a feed is a caller's code: whatever it raises ends this binding alone
        return (str(error).splitlines() or [type(error).__name__])[0]
    return None


def ingest(spark: SparkSession, bindings: dict[str, Feed], landing: str, target: str, start: dt.date, end: dt.date,
           now: dt.datetime) -> list[BindingResult]:
    """Read, land, validate and load all bindings; a bad one contributes nothing and stops no other.

    Each binding lands in a folder of its own, a few at a time, so one that fails while it is read fails alone. The landed
    files are what is validated and loaded, so sources are read once.
    """
    run = f"{landing}/dt={now.date().isoformat()}/run={uuid.uuid4().hex[:12]}"
    folders = {name: f"{run}/{i:05d}" for i, name in enumerate(bindings)}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        errors = dict(zip(bindings, pool.map(
            lambda name: _landed(spark, name, bindings[name], folders[name], start, end, now), bindings)))
    results = [BindingResult(name, "failed", reason=reason) for name, reason in errors.items() if reason is not None]
    feeds = [name for name, reason in errors.items() if reason is None]
    if not feeds:
        return results
    landed = sinks.read_landing(spark, [folders[name] for name in feeds])
    # One row per binding and month: the configured list bounds what reaches the driver.
    counts: dict[str, int] = {}
    bad: dict[str, str] = {}
    for r in validate.verdict(landed.withColumn("month", month()), ["_binding", "month"]).collect():
        counts[r["_binding"]] = counts.get(r["_binding"], 0) + r["row_count"]
        if not r["ok"]:
            bad[r["_binding"]] = ""
    if bad:  # only the failing bindings' files are read again
        failed = sinks.read_landing(spark, [folders[name] for name in bad])
        bad = {r["_binding"]: r["reason"] for r in reasons(failed).collect()}
    for name in feeds:
        if name in bad:
            results.append(BindingResult(name, "failed", reason=bad[name]))
        else:
            results.append(BindingResult(name, "loaded" if name in counts else "empty", counts.get(name, 0)))
    loaded = [r.binding for r in results if r.status == "loaded"]
    if loaded:
        sinks.replace_charges(spark, sinks.read_landing(spark, [folders[name] for name in loaded]), target)
    return results


def exit_code(results: list[BindingResult]) -> int:
    """Non-zero only when there are bindings and all failed."""
    return int(bool(results) and all(r.status == "failed" for r in results))


def opportunities(spark: SparkSession, charges: str, target: str, now: dt.datetime) -> None:
    """Detect over the trailing window and replace today's snapshot."""
    today = now.date()
    found = optimize.detect(warehouse.opportunity_window(spark, charges, today))
    sinks.replace_snapshot(spark, optimize.snapshot(found, today, now), target, today)
