"""Idempotent writes: landing files, window replacement, snapshots.

A table is a folder of versions and a folder of numbered manifests. A replacement writes its rows as a new version, then
creates the next manifest exclusively: of two writers one is first, and the other reads again and takes the number after. The manifest names the versions in order and the windows each of them replaced:
readers take a version's rows without the windows of later ones. So a reader sees the table before or after a replacement,
never in between; a run that dies leaves a version that no manifest names; and what the driver does depends on the
number of bindings, not on days or files.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from spendframe.functions import focus

PARTITIONS = ["charge_date", "_binding"]
#: Times a writer starts again from the newest manifest when others keep coming first.
TRIES = 50


class Conflict(OSError):
    """Another writer created the manifest first."""


def typed(rows: DataFrame) -> DataFrame:
    """Exactly the warehouse columns in order and type; extensions are dropped."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in focus.warehouse_schema().fields])


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows placed for partitioned files: one shuffle by partition, hot partitions split.

    The rebalance hint lets adaptive execution cut an oversized (day, binding) into several
    tasks, so no partition has to fit one task. Sorting inside files keeps the usual filter
    columns' row groups narrow.
    """
    dated = rows.withColumn("charge_date", F.col("ChargePeriodStart").cast("date"))
    return (dated.hint("rebalance", *[F.col(c) for c in PARTITIONS])
            .sortWithinPartitions(*PARTITIONS, "ProviderName", "ServiceCategory", "tag_application"))


def write_landing(rows: DataFrame, path: str) -> None:
    """Typed Parquet of one binding: columns without a value keep their type."""
    typed(rows).write.mode("overwrite").parquet(path)


def read_landing(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(focus.warehouse_schema()).parquet(*paths)


class Manifests:
    """The numbered manifests of a table, through the Hadoop file system of its path."""

    def __init__(self, spark: SparkSession, target: str):
        self._jvm, self.target = spark._jvm, target.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, relative: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{relative}" if relative else self.target)

    def latest(self) -> tuple[int, list[dict]]:
        """Number and versions of the newest manifest; 0 and none before the first."""
        folder = self._path("_manifests")
        if not self._fs.exists(folder):
            return 0, []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, []
        stream = self._fs.open(self._path(f"_manifests/{max(numbers):010d}.json"))
        try:
            return max(numbers), json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, versions: list[dict]) -> None:
        """Create manifest `number`, whole or not at all; `Conflict` if another writer was first.

        Each kind of store has its own exclusive step: a hard link on local disks, a rename that never overwrites on HDFS, and
        on object stores a create that fails if the object is there, which shows the object only when it is complete.
        """
        body, name = json.dumps(versions).encode(), self._path(f"_manifests/{number:010d}.json")
        scheme = self._fs.getUri().getScheme()
        draft = name if scheme not in ("file", "hdfs", "viewfs") else self._path(f"_manifests/_draft-{uuid.uuid4().hex}")
        try:
            self._fs.mkdirs(name.getParent())
            stream = self._fs.create(draft, False)
            try:
                stream.write(body)
            finally:
                stream.close()
            if scheme == "file":
                os.link(draft.toUri().getPath(), name.toUri().getPath())
            elif draft is not name and not self._fs.rename(draft, name):
                raise FileExistsError
        except (Py4JJavaError, FileExistsError) as error:
            if self._fs.exists(name):
                raise Conflict(f"{self.target}: manifest {number} is another run's") from error
            raise
        finally:
            if draft is not name:
                self._fs.delete(draft, False)

    def drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def folders(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path("")) if f.getPath().getName().startswith("v-")]


def _inside(window: dict, day: str, key: str | None) -> Column:
    bound = (F.col(day) >= F.lit(window["lo"]).cast("date")) & (F.col(day) <= F.lit(window["hi"]).cast("date"))
    return bound & F.col(key).eqNullSafe(F.lit(window["key"])) if key else bound


def within(rows: DataFrame, windows: list[dict], day: str, key: str | None = None) -> DataFrame:
    """The rows inside any window."""
    return rows.filter(reduce(lambda a, b: a | b, [_inside(w, day, key) for w in windows]))


def without(rows: DataFrame, windows: list[dict], day: str, key: str | None = None) -> DataFrame:
    """The rows outside every window. Only partition columns are asked, so whole files are left out."""
    return reduce(lambda df, w: df.filter(~F.coalesce(_inside(w, day, key), F.lit(False))), windows, rows)


def replaced(current: DataFrame, new: DataFrame, windows: list[dict], day: str, key: str | None = None) -> DataFrame:
    """What a table holds after a replacement: its rows outside the windows, and all new ones."""
    return without(current, windows, day, key).unionByName(new)


def read_table(spark: SparkSession, target: str, schema: StructType | str, day: str, key: str | None = None) -> DataFrame:
    """The table as of its newest manifest; `schema` includes the partition columns. Without a manifest it is empty."""
    _, versions = Manifests(spark, target).latest()
    out = spark.createDataFrame([], schema)
    parts, later = [], []
    for version in reversed(versions):
        parts.append(without(spark.read.schema(schema).parquet(f"{target.rstrip('/')}/{version['folder']}"), later, day, key))
        later = later + version["windows"]
    return reduce(DataFrame.unionByName, parts) if parts else out


def _covered(version: dict, later: list[dict]) -> bool:
    """Whether later windows take in all of a version, so that it can be forgotten."""
    return all(any(w["key"] == v["key"] and w["lo"] <= v["lo"] and v["hi"] <= w["hi"] for w in later) for v in version["windows"])


def replace_windows(spark: SparkSession, rows: DataFrame, target: str, by: list[str], day: str, key: str | None = None,
                    windows: list[dict] | None = None) -> None:
    """Write `rows` as a version that replaces `windows`: by default each key's first to last new day."""
    manifests = Manifests(spark, target)
    folder = f"v-{uuid.uuid4().hex[:12]}"
    path = f"{manifests.target}/{folder}"
    try:
        rows.write.partitionBy(*by).parquet(path)
        if windows is None:
            found = spark.read.schema(rows.schema).parquet(path).groupBy(key).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
            windows = [{"key": r[key], "lo": str(r["lo"]), "hi": str(r["hi"])} for r in found.collect()]
        for left in reversed(range(TRIES)):
            number, versions = manifests.latest()
            later, kept = list(windows), []
            for version in reversed(versions):
                if not _covered(version, later):
                    kept.insert(0, version)
                    later += version["windows"]
            try:
                manifests.publish(number + 1, [*kept, {"folder": folder, "windows": windows}])
                break
            except Conflict:
                if not left:
                    raise
    except BaseException:
        manifests.drop(folder)
        raise


def vacuum(spark: SparkSession, target: str) -> list[str]:
    """Delete the versions the newest manifest doesn't name; run it when no reader of an older one is left."""
    manifests = Manifests(spark, target)
    named = {v["folder"] for v in manifests.latest()[1]}
    old = [f for f in manifests.folders() if f not in named]
    for folder in old:
        manifests.drop(folder)
    return old


def replace_charges(spark: SparkSession, rows: DataFrame, target: str) -> None:
    """Replace each binding's days from its first to its last new charge day.

    Days the feed no longer has disappear as well. The range is per binding, so a binding with
    a shorter feed keeps its older days. One row per binding reaches the driver.
    """
    replace_windows(spark, laid_out(typed(rows)), target, PARTITIONS, "charge_date", "_binding")


def replace_snapshot(spark: SparkSession, rows: DataFrame, target: str, as_of) -> None:
    """Replace one `as_of`; without rows the day is emptied and readers see the one before."""
    day = {"key": None, "lo": as_of.isoformat(), "hi": as_of.isoformat()}
    replace_windows(spark, rows.coalesce(1), target, ["as_of"], "as_of", None, [day])
