"""What the first line of a text file or the footer of a Parquet file tells, looked up in tasks.

Tasks open files through Arrow's file systems (local, HDFS, S3, GCS, ABFS). Only file names and short answers pass the driver.
A file that can't be opened so, or that does not tell, answers None; callers then ask in another way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from spendframe.functions import focus

BLOCK = 1 << 16


def _asked(spark: SparkSession, uris: list[str], answer: Callable[[str], dict], schema: str) -> DataFrame:
    """`answer` of each file (columns of `schema`) beside its number in `uris`."""
    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [{"n": n, **answer(uri)} for n, uri in zip(batch["n"], batch["uri"])]
            yield pd.DataFrame(rows, columns=names)

    names = ["n", *[part.split()[0] for part in schema.split(",")]]
    tasks = min(len(uris), 4 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame(list(enumerate(uris)), "n int, uri string").repartitionByRange(tasks, "n")
    return listed.mapInPandas(ask, f"n int, {schema}")


def first_line(uri: str) -> str | None:
    """The first line of a file, uncompressed by its extension; read in blocks up to its end and no further."""
    from pyarrow import fs

    try:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path, compression="detect") as stream:
            line = b""
            while b"\n" not in line and (block := stream.read(BLOCK)):
                line += block
    except (OSError, ValueError, NotImplementedError):
        return None
    return line.split(b"\n", 1)[0].decode("utf-8", "replace").lstrip("﻿").rstrip("\r")


def first_lines(spark: SparkSession, uris: list[str]) -> list[str | None]:
    """The first line of each file, in the order given. Equal lines are sent once, with the numbers of their files."""
    if not uris:
        return []
    lines = _asked(spark, uris, lambda uri: {"line": first_line(uri)}, "line string").groupBy("line").agg(F.collect_list("n").alias("files"))
    out: list[str | None] = [None] * len(uris)
    for row in lines.collect():
        for n in row["files"]:
            out[n] = row["line"]
    return out


def null_counts(uri: str, column: str) -> tuple[int, int | None]:
    """Rows of a Parquet file and the nulls among them in `column` (a file without it: all); None where the footer is silent."""
    from pyarrow import fs, parquet

    try:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            meta = parquet.ParquetFile(file).metadata
    except (OSError, ValueError, NotImplementedError):
        return 0, None
    at = [i for i in range(meta.num_columns) if meta.schema.column(i).path.lower() == column.lower()]
    if not at:
        return meta.num_rows, meta.num_rows
    stats = [meta.row_group(g).column(at[0]).statistics for g in range(meta.num_row_groups)]
    told = all(s is not None and s.has_null_count for s in stats)
    return meta.num_rows, sum(s.null_count for s in stats) if told else None


def all_null(raw: DataFrame, names: list[str]) -> dict[str, bool]:
    """Columns of a Parquet feed that its footers decide: True is null in all rows, False in none.

    Names are canonical; a feed may have them under an alias. Columns with some nulls, and those a footer does not tell of,
    are left out: whether the rows of a window are all null needs the rows.
    """
    spelled = {focus.COLUMN_ALIASES.get(c, c): c for c in raw.columns if c in focus.COLUMN_ALIASES}
    spelled |= {c: c for c in raw.columns if c in names}
    asked, uris = [n for n in names if n in spelled], raw.inputFiles()
    if not asked or not uris:
        return {}

    def answer(uri: str) -> dict:
        counts = [null_counts(uri, spelled[n]) for n in asked]
        return {"rows": counts[0][0], **{f"c{i}": nulls for i, (_, nulls) in enumerate(counts)}}

    schema = ", ".join(["rows long", *[f"c{i} double" for i in range(len(asked))]])
    nulls = [F.when(F.count_if(F.col(f"c{i}").isNull() | F.isnan(f"c{i}")) == 0, F.sum(f"c{i}")) for i in range(len(asked))]
    rows, *sums = _asked(raw.sparkSession, uris, answer, schema).agg(F.sum("rows"), *nulls).first()
    return {n: s == rows for n, s in zip(asked, sums) if s is not None and s in (0, rows)}
