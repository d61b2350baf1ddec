"""Totals over a whole report beside each of its rows, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 32


def beside_totals(report: DataFrame, keys: list[str], totals: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """`report` with the aggregates `totals` of all its rows added to each.

    `keys` tell the rows of the report apart. The totals are the empty grouping set of a second aggregate over the report:
    one row, summed in every task before it is shuffled. It is copied to `parts` parts, and each row takes the copy of the
    part its keys fall in. So what lies below the report is planned and read once, and no task gets all rows.
    """
    measures = [c for c in report.columns if c not in keys]
    both = report.groupingSets([keys, []], *keys).agg(
        *[F.max(c).alias(c) for c in measures], *[t.alias(name) for name, t in totals.items()], F.grouping_id().alias("_of_all"))
    own = F.array(F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = both.withColumn("_part", F.explode(F.when(F.col("_of_all") == 0, own).otherwise(every)))
    # One row of a part is the totals; it comes first.
    part = Window.partitionBy("_part").orderBy(F.desc("_of_all")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dealt.withColumns({name: F.first(name).over(part) for name in totals})
            .filter("_of_all = 0").select(*report.columns, *totals))


def largest(report: DataFrame, label: str, value: str, k: int, parts: int = PARTS) -> DataFrame:
    """`report` (one row per label) with `largest`, the labels of its `k` largest values, and `labels`, their number in all.

    Ties go to the smaller label. A label can only be among them if it is one of the `k` largest of its part, so the ranks are
    per part and at most `k` labels of each part meet in the totals.
    """
    measures = [c for c in report.columns if c != label]
    part = Window.partitionBy(F.pmod(F.xxhash64(label), F.lit(parts))).orderBy(F.desc(value), label)
    ranked = report.withColumn("_near", F.row_number().over(part) <= k)
    entry = F.struct(F.col(value).isNull().alias("none"), (-F.col(value)).alias("v"), F.col(label).alias("label"))
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("_near"), entry))), 1, max(k, 1)) if k > 0 else F.array().cast(
        f"array<struct<none:boolean,v:{dict(report.dtypes)[value]},label:{dict(report.dtypes)[label]}>>")
    both = beside_totals(ranked, [label], {"_top": top, "labels": F.count(F.lit(1))}, parts)
    return both.select(label, *measures, F.transform("_top", lambda e: e["label"]).alias("largest"), "labels")
