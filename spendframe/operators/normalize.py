"""Bring a billing feed to the canonical columns, types and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spendframe.functions import focus


def rename_aliases(df: DataFrame) -> DataFrame:
    """Other versions' column names to canonical ones, unless the canonical one is there."""
    present = set(df.columns)
    return df.withColumnsRenamed({
        alias: name for alias, name in focus.COLUMN_ALIASES.items()
        if alias in present and name not in present
    })


def conform(df: DataFrame) -> DataFrame:
    """Spec columns first (missing ones as typed nulls), extras after, in their order."""
    present = set(df.columns)
    spec = [F.col(name) if name in present else F.lit(None).cast(focus.SPARK_TYPE[kind]).alias(name)
            for name, kind in focus.KIND.items()]
    extras = [F.col(name) for name in df.columns if name not in focus.KIND]
    return df.select(*spec, *extras)


def tolerant_cast(df: DataFrame) -> DataFrame:
    """Cast decimals and datetimes of the spec; a value that does not parse becomes null.

    Zoned text becomes UTC wall time, which needs a UTC session (see `session.SETTINGS`).
    """
    types = dict(df.dtypes)
    out = {}
    for name, kind in focus.KIND.items():
        if name not in types:
            continue
        if kind == "decimal":
            out[name] = F.expr(f"try_cast(`{name}` AS DECIMAL(28,9))")
        elif kind == "datetime" and types[name] != "timestamp_ntz":
            out[name] = F.expr(f"try_cast(try_cast(`{name}` AS TIMESTAMP) AS TIMESTAMP_NTZ)")
    return df.withColumns(out)


def fold_tag_key(key: Column) -> Column:
    """Trim, lower-case, `-` and blanks to `_`."""
    return F.translate(F.lower(F.regexp_replace(key, r"^\s+|\s+$", "")), "- ", "__")


def _canonical(folded: Column) -> Column:
    """The canonical key a folded key stands for, else null."""
    out = F.when(folded.isin(focus.CANONICAL_TAGS), folded)
    for tag, aliases in focus.TAG_ALIASES.items():
        out = out.when(folded.isin(aliases), F.lit(tag))
    return out


def canonical_tag_key(key: Column) -> Column:
    """The canonical key a raw key folds onto, else null."""
    return _canonical(fold_tag_key(key))


def explode_tags(df: DataFrame, prefix: str = "tag_") -> DataFrame:
    """`Tags` (map or JSON text) to one column per canonical tag.

    Empty, null and the text `null` do not count; the last matching key wins; rows without
    a usable value, or with text that is no JSON object, get `Unallocated`.
    """
    if "Tags" not in df.columns:
        return df.withColumns({f"{prefix}{t}": F.lit(focus.UNALLOCATED) for t in focus.CANONICAL_TAGS})
    parsed = F.col("Tags")
    if not isinstance(df.schema["Tags"].dataType, T.MapType):
        parsed = F.from_json(parsed, "map<string,string>")
    present = F.filter(F.map_entries(parsed), lambda e: ~e["value"].cast("string").isin("", "null"))
    # A key is folded once; everything after looks at the folded text.
    folded = F.transform(present, lambda e: F.struct(fold_tag_key(e["key"]).alias("key"), e["value"].cast("string").alias("value")))
    named = F.filter(F.transform(folded, lambda e: F.struct(_canonical(e["key"]).alias("tag"), e["value"].alias("value"))), lambda e: e["tag"].isNotNull())

    def last(tag: str) -> Column:
        return F.get("_tags.value", (F.array_position("_tags.tag", tag) - 1).cast("int"))

    return df.withColumn("_tags", F.reverse(named)).withColumns({
        f"{prefix}{tag}": F.coalesce(last(tag), F.lit(focus.UNALLOCATED)) for tag in focus.CANONICAL_TAGS
    }).drop("_tags")


def serialize_tags(df: DataFrame) -> DataFrame:
    """Map tags to JSON text; null to `{}`; text stays."""
    if "Tags" not in df.columns:
        return df
    tags = F.col("Tags")
    if isinstance(df.schema["Tags"].dataType, T.MapType):
        tags = F.to_json(tags)
    return df.withColumn("Tags", F.coalesce(tags, F.lit("{}")))


def normalize(df: DataFrame) -> DataFrame:
    """Rename, conform, cast. Mandatory values are never invented."""
    return tolerant_cast(conform(rename_aliases(df)))


def fill_all_null(df: DataFrame, values: dict[str, str], raw: DataFrame | None = None,
                  known: dict[str, bool] | None = None) -> DataFrame:
    """Each column's value where the *whole* column is null; partly filled columns stay untouched.

    `raw` is the frame before `normalize`: columns it lacks need no check, nor do those of which is `known` that they are
    null in all rows or in none. All others are asked in one scalar subquery over just those columns.
    """
    have = set(rename_aliases(raw).columns) if raw is not None else set(df.columns)
    known = {c: True for c in values if c not in have} | (known or {})
    asked = [c for c in values if c not in known]
    out = df.withColumns({c: F.lit(v) for c, v in values.items() if known.get(c)})
    if not asked:
        return out
    absent = df.agg(F.struct(*[(F.count(c) == 0).alias(c) for c in asked]).alias("absent")).scalar()
    return out.withColumns({c: F.when(absent[c], F.lit(values[c])).otherwise(F.col(c)) for c in asked})


def fill_if_all_null(df: DataFrame, column: str, value: str, raw: DataFrame | None = None,
                     known: dict[str, bool] | None = None) -> DataFrame:
    return fill_all_null(df, {column: value}, raw, known)


def stamp_issuer(df: DataFrame, vendor: str, raw: DataFrame | None = None, known: dict[str, bool] | None = None) -> DataFrame:
    """The vendor as invoice issuer when the feed names none."""
    return fill_if_all_null(df, "InvoiceIssuerName", vendor, raw, known)
