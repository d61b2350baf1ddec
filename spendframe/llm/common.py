"""What the training-data operators share: tables, shared scratch space, text columns, skew-proof ranks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Rows and bytes of one Arrow batch: a task holds one batch of whole texts at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder every executor shares (spark.checkpoint.dir); one of our own only where none is set and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spendframe-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, and it is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `stored`, with the path for `dropped`."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables of `written` that no later step reads, in whatever store they are."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't use, whatever the case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def annotate(df: DataFrame, inputs: list[str], compute: Callable[..., Iterable[tuple]], fields: T.StructType | str,
             name: str) -> DataFrame:
    """`df` with one more column, a struct of `fields`, that `compute` makes from the `inputs` of each batch.

    `compute` takes one list per input and gives one tuple per row, in order.
    """
    struct = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    arrow = pa.struct([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in struct.fields])
    places = [df.columns.index(c) for c in inputs]
    names = [f.name for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(compute(*[batch.column(i).to_pylist() for i in places]))
            made = pa.array([dict(zip(names, row)) for row in rows], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, struct)]))


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<binary>": pa.list_(pa.binary()),
}


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def flat(df: DataFrame, struct: str, *others: Column | str) -> DataFrame:
    """The struct's fields beside `others`, as plain columns."""
    return df.select(*others, *[F.col(f"`{struct}`.`{f.name}`").alias(f.name) for f in df.schema[struct].dataType.fields])


def seeded(seed: int, *columns: Column | str) -> Column:
    """A fixed pseudo-random long for a row."""
    return F.xxhash64(*columns, F.lit(seed))


def rank_in(df: DataFrame, keys: list[str], order: list[str], seed: int, name: str, parts: int = 256) -> DataFrame:
    """`df` with the row's place (from 0) within `keys`, in seeded order, ties by `order`.

    A key is dealt into `parts` parts by the hash; rows are ranked within a part, and the sizes of the
    parts before it are added. So no task gathers a whole key, however many rows it holds.
    """
    hashed, part, before = (fresh(df, c) for c in ("_hash", "_part", "_before"))
    dealt = df.withColumn(hashed, seeded(seed, *order)).withColumn(part, F.pmod(F.shiftright(hashed, 20), F.lit(parts)))
    ordered = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (dealt.groupBy(*keys, part).agg(F.count("*").alias("_n"))
             .select(*keys, part, F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias(before)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, part]]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    joined = dealt.alias("l").join(sizes.alias("r"), on).select("l.*", f"r.{before}")
    within = Window.partitionBy(*keys, part).orderBy(hashed, *order)
    return joined.withColumn(name, F.col(before) + F.row_number().over(within) - 1).drop(hashed, part, before)


def sliding(values: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """`pick` (np.minimum or np.maximum) of every run of `span` values."""
    out, width = values, 1
    while width * 2 <= span:
        out = pick(out[:-width], out[width:])
        width *= 2
    return out if width == span else pick(out[: len(values) - span + 1], out[span - width:])


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window of `span` hashes (all of them if it occurs twice).

    Every window has at least one, and equal windows have them at equal places. Fewer hashes are one window.
    """
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    span = min(span, len(hashes))
    lowest, edge = sliding(hashes, span, np.minimum), np.zeros(span - 1, hashes.dtype)
    return np.flatnonzero(sliding(np.concatenate([edge, lowest, edge]), span, np.maximum) == hashes)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash spread over all of it."""
    out = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


#: Odd multipliers without a pattern, one for each place in a run.
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k (at most 64) hashes."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _ODD[0]
    for i in range(1, k):
        out += hashes[i:i + n] * _ODD[i]
    return mixed(out)


def rows_hashed(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a table of hashes; a row equal to a run has the hash that `grams` gives it."""
    return mixed((rows * _ODD[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))
