"""Conformance checks as grouped aggregates.

One wide aggregate counts every rule per group (for an ingest: binding and month); the verdict
needs nothing else. Where the offending values are listed, they are part of that aggregate's key (an
array, empty for a sound row), so counts and values come from one pass over the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendframe.functions import focus
from spendframe.functions.columns import day


def missing_columns(df: DataFrame) -> list[str]:
    """Mandatory columns the frame lacks (a schema check, no job)."""
    return [name for name in focus.MANDATORY if name not in df.columns]


def _outside(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.col(name).cast("string").isin(focus.ENUMS[name])


def _bad_pair() -> Column:
    valid = reduce(lambda a, b: a | b, [
        (F.col("ServiceCategory") == category) & F.col("ServiceSubcategory").isin(names)
        for category, names in focus.SUBCATEGORIES.items()
    ])
    return F.col("ServiceCategory").isNotNull() & F.col("ServiceSubcategory").isNotNull() & ~valid


def _checks(columns: list[str]) -> dict[tuple[str, str, str], Column]:
    """(severity, rule, column) -> rows breaking it, for the columns the frame has."""
    have = set(columns)
    checks: dict[tuple[str, str, str], Column] = {}
    for name in focus.NOT_NULLABLE:
        if name in have:
            checks["error", "null", name] = F.count_if(F.col(name).isNull())
    for name in focus.ENUMS:
        if name in have:
            checks["error", "enum", name] = F.count_if(_outside(name))
    if {"ChargeFrequency", "ChargeCategory"} <= have:
        checks["error", "purchase_usage_based", "ChargeFrequency"] = F.count_if(
            (F.col("ChargeCategory") == "Purchase") & (F.col("ChargeFrequency") == "Usage-Based"))
    if {"CommitmentDiscountId", "CommitmentDiscountType"} <= have:
        checks["error", "commitment_type", "CommitmentDiscountType"] = F.count_if(
            F.col("CommitmentDiscountId").isNotNull() & F.col("CommitmentDiscountType").isNull())
    for name in focus.RECOMMENDED:
        if name in have:
            checks["warning", "all_null", name] = F.when(F.count(name) == 0, F.count(F.lit(1))).otherwise(0)
    return checks


def _issue(severity: str, rule: str, column: str, n: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                    F.lit(column).alias("column"), n.cast("bigint").alias("n"))


def _has_pairs(df: DataFrame) -> bool:
    return {"ServiceCategory", "ServiceSubcategory"} <= set(df.columns)


def counted(df: DataFrame, keys: list[str] = [], more: dict[str, Column] = {}) -> DataFrame:
    """Per group: row count, distinct bad pairs, `found`, the array of broken counting rules, and the aggregates `more`."""
    checks = _checks(df.columns)
    pair = F.when(_bad_pair(), F.struct("ServiceCategory", "ServiceSubcategory")) if _has_pairs(df) else F.lit(None)
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(pair).alias("bad_pairs"),
                                 *[n.alias(f"c{i}") for i, n in enumerate(checks.values())],
                                 *[n.alias(name) for name, n in more.items()])
    found = [_issue(*rule, F.col(f"c{i}")) for i, rule in enumerate(checks)]
    missing = [_issue("error", "missing_column", c, F.lit(0)) for c in missing_columns(df)]
    broken = F.filter(F.array(*found), lambda i: i["n"] > 0)
    return wide.select(*keys, "row_count", "bad_pairs", *more, F.concat(broken, F.array(*missing)).alias("found")
                       if missing else broken.alias("found"))


def enum_samples(df: DataFrame, keys: list[str] = [], most: int | None = None) -> DataFrame:
    """Per enum column the values outside it, all or the first `most`, sorted."""
    names = [name for name in focus.ENUMS if name in df.columns]
    pairs = F.array(*[F.when(_outside(name), F.struct(F.lit(name).alias("column"),
                                                     F.col(name).cast("string").alias("value")))
                      for name in names])
    values = df.select(*keys, F.explode(pairs).alias("p")).filter("p is not null").select(
        *keys, "p.column", "p.value").distinct()
    if most is not None:  # a row number limit is cut per partition before the shuffle, however many values there are
        first = Window.partitionBy(*keys, "column").orderBy("value")
        values = values.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= most)
    return (values.groupBy(*keys, "column")
            .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("sample")))


def _offences(df: DataFrame) -> Column:
    """The values and pairs of a row that break an enum or the subcategory rule; empty for a sound row."""
    def entry(severity: str, rule: str, column: str, value: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), value.alias("value"))

    found = [F.when(_outside(c), entry("error", "enum", c, F.col(c).cast("string"))) for c in focus.ENUMS if c in df.columns]
    if _has_pairs(df):
        found.append(F.when(_bad_pair(), entry("warning", "subcategory", "ServiceSubcategory", F.concat_ws(" / ", "ServiceCategory", "ServiceSubcategory"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast(
        "array<struct<severity:string,rule:string,column:string,value:string>>")


def issues(df: DataFrame, keys: list[str] = [], strict: bool = False) -> DataFrame:
    """All findings, tidy: keys, severity, rule, column, n, sample.

    An enum's sample is its offending values in order; every offending pair is a finding of its own. Both and all counts
    come from one aggregate over the rows.
    """
    checks = {rule: n for rule, n in _checks(df.columns).items() if rule[1] not in ("enum", "all_null")}
    hollow = [c for c in focus.RECOMMENDED if c in df.columns]
    report = df.withColumn("_bad", _offences(df)).groupBy(*keys, "_bad").agg(
        F.count(F.lit(1)).alias("_rows"), *[n.alias(f"_c{i}") for i, n in enumerate(checks.values())],
        *[F.count(c).alias(f"_f{i}") for i, c in enumerate(hollow)])

    def entry(severity: Column, rule: Column, column: Column, n: Column, filled: Column | None = None, value: Column | None = None) -> Column:
        return F.struct(severity.alias("severity"), rule.alias("rule"), column.alias("column"), n.cast("bigint").alias("n"),
                        (F.lit(0) if filled is None else filled).cast("bigint").alias("filled"),
                        (F.lit(None) if value is None else value).cast("string").alias("value"))

    plain = [entry(*map(F.lit, rule), F.col(f"_c{i}")) for i, rule in enumerate(checks)]
    plain += [entry(F.lit("warning"), F.lit("all_null"), F.lit(c), F.col("_rows"), F.col(f"_f{i}")) for i, c in enumerate(hollow)]
    absent = missing_columns(df)
    plain += [entry(F.lit("error"), F.lit("missing_column"), F.lit(c), F.lit(0)) for c in absent if keys]
    bad = F.transform("_bad", lambda b: entry(b["severity"], b["rule"], b["column"], F.col("_rows"), None, b["value"]))
    said = F.filter(F.concat(F.array(*plain), bad) if plain else bad, lambda e: (e["n"] > 0) | (e["rule"] == "missing_column"))
    rows = report.select(*keys, F.explode(said).alias("e")).select(*keys, "e.*")
    pair = F.when(F.col("rule") == "subcategory", F.col("value"))
    found = rows.groupBy(*keys, "severity", "rule", "column", pair.alias("_pair")).agg(
        F.sum("n").alias("n"), F.sum("filled").alias("_filled"), F.array_sort(F.collect_set("value")).alias("_values"))
    out = found.filter("_filled = 0").select(*keys, F.lit("error").alias("severity") if strict else "severity", "rule", "column", "n",
                                             F.when(F.size("_values") > 0, F.array_join("_values", ", ")).alias("sample"))
    if absent and not keys:  # the schema alone tells, rows or none
        listed = df.sparkSession.createDataFrame([("error", "missing_column", c, 0, None) for c in absent],
                                                 "severity string, rule string, column string, n bigint, sample string")
        out = out.unionByName(listed)
    return out


def verdict(df: DataFrame, keys: list[str] = [], strict: bool = False, more: dict[str, Column] = {}) -> DataFrame:
    """Per group: row count, errors, warnings, ok and the aggregates `more`, from one pass."""
    def having(severity: str) -> Column:
        return F.size(F.filter("found", lambda i: i["severity"] == severity)).cast("bigint")

    errors, warnings = having("error"), having("warning") + F.col("bad_pairs")
    if strict:
        errors, warnings = errors + warnings, F.lit(0).cast("bigint")
    return counted(df, keys, more).select(*keys, "row_count", errors.alias("errors"), warnings.alias("warnings"),
                                          (errors == 0).alias("ok"), *more)


def provenance(df: DataFrame) -> DataFrame:
    """One row: rows, first and last charge day, and whether the feed conforms, from one pass."""
    seen = counted(df, more={"period_start": F.min(day()), "period_end": F.max(day())})
    return seen.select(F.col("row_count").alias("rows"), "period_start", "period_end",
                       (~F.exists("found", lambda i: i["severity"] == "error")).alias("conformant"))


def schema_parity(actual, expected=None) -> list[str]:
    """Differences between a table schema and the warehouse schema; empty when they agree."""
    expected = expected or focus.warehouse_schema()
    have = {f.name: f for f in actual.fields}
    want = {f.name: f for f in expected.fields}
    out = [f"missing {name}" for name in want if name not in have]
    out += [f"unexpected {name}" for name in have if name not in want]
    out += [f"type of {name}: {have[name].dataType.simpleString()} is not {field.dataType.simpleString()}"
            for name, field in want.items() if name in have and have[name].dataType != field.dataType]
    out += [f"{name} must not be nullable" for name, field in want.items()
            if name in have and have[name].nullable and not field.nullable]
    return out
