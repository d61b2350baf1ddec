import datetime as dt

from pyspark.sql import functions as F

from spendframe.functions import focus
from spendframe.operators import normalize as nz, validate as va


def test_alias_only_when_target_is_absent(spark):
    df = spark.createDataFrame([(1.0, 2.0, "Usage")], "AmortizedCost double, EffectiveCost double, ChargeType string")
    assert nz.rename_aliases(df).columns == ["AmortizedCost", "EffectiveCost", "ChargeCategory"]


def test_conform_orders_and_keeps_extras(spark):
    out = nz.conform(spark.createDataFrame([("x", "AWS")], "zz string, ProviderName string"))
    assert out.columns == focus.COLUMNS + ["zz"] and len(focus.COLUMNS) == 57


def test_bad_values_become_null(spark, one):
    df = spark.createDataFrame([("x", "nope"), ("1.5", "2024-02-03 04:05:06"), (" 2e1 ", "2024-01-01T00:00:00+02:00")],
                               "EffectiveCost string, ChargePeriodStart string")
    rows = nz.tolerant_cast(df).orderBy("EffectiveCost").collect()
    assert [r[0] is None for r in rows] == [True, False, False]
    assert rows[1][1] == dt.datetime(2024, 2, 3, 4, 5, 6) and float(rows[2][0]) == 20.0
    assert rows[2][1] == dt.datetime(2023, 12, 31, 22, 0)


def test_tags_from_text_map_and_junk(spark):
    texts = ['{"App-Name": "a", "application": "b", " BU ": "x", "env": "", "owner": "null"}', "not json", "[1]", None,
             '{"app": "a", "app": "z"}', '{"cost center": "cc1", "PROJ": 7, "gl-code": "cc2"}']
    out = nz.explode_tags(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, Tags string"))
    got = {r["i"]: [r[c] for c in focus.TAG_COLUMNS] for r in out.collect()}
    u = "Unallocated"
    assert got[0] == ["b", "x", u, u, u, u]
    assert got[1] == got[2] == got[3] == [u] * 6
    assert got[4][0] == "z"
    assert got[5] == [u, u, "cc2", u, u, "7"]
    maps = spark.createDataFrame([({"App": "m"},)], "Tags map<string,string>")
    assert nz.explode_tags(maps).first()["tag_application"] == "m"


def test_serialise(spark):
    maps = spark.createDataFrame([({"a": "1"},), (None,)], "Tags map<string,string>")
    assert {r[0] for r in nz.serialize_tags(maps).collect()} == {'{"a":"1"}', "{}"}


def test_issuer_only_for_a_wholly_empty_column(spark):
    base = "InvoiceIssuerName string"
    half = spark.createDataFrame([("x",), (None,)], base)
    none = spark.createDataFrame([(None,), (None,)], base)
    assert [r[0] for r in nz.stamp_issuer(half, "V").collect()] == ["x", None]
    assert [r[0] for r in nz.stamp_issuer(none, "V").collect()] == ["V", "V"]


def full(spark, n=3, **fields):
    """Conformant rows with constants, some columns replaced by expressions."""
    df = spark.range(n).select(
        "id", *[F.lit("x" if k != "decimal" else "1").alias(c) for c, k in focus.KIND.items() if c in focus.MANDATORY])
    known = {"ChargeCategory": "Usage", "ServiceCategory": "Compute", "ChargePeriodStart": "2024-01-01", "ChargeClass": None,
             "ChargePeriodEnd": "2024-01-02", "BillingPeriodStart": "2024-01-01", "BillingPeriodEnd": "2024-02-01",
             "ChargeFrequency": "Recurring", "ServiceSubcategory": "Containers", "AvailabilityZone": "a"}
    df = df.withColumns({c: F.lit(v) for c, v in known.items()}).withColumns(fields)
    return nz.normalize(df).drop("id")


def test_clean_feed_is_ok(spark, one):
    assert one(va.verdict(full(spark))) == {"row_count": 3, "errors": 0, "warnings": 0, "ok": True}


def test_enum_sample_is_sorted_and_short(spark):
    bad = full(spark, 20, ChargeCategory=F.concat(F.lit("c"), F.col("id").cast("string")))
    row = va.issues(bad).collect()[0]
    assert (row["column"], row["n"], row["sample"]) == ("ChargeCategory", 20, ", ".join(sorted(f"c{i}" for i in range(20))))
    short = va.enum_samples(bad, most=5).filter("column = 'ChargeCategory'").collect()
    assert [r["sample"] for r in short] == ["c0, c1, c10, c11, c12"]


def test_strict_turns_warnings_into_errors(spark, one):
    df = full(spark, ServiceSubcategory=F.lit("Bots"))
    assert one(va.verdict(df))["warnings"] == 1
    strict = one(va.verdict(df, strict=True))
    assert strict["errors"] == 1 and not strict["ok"]
    assert {r["severity"] for r in va.issues(df, strict=True).collect()} == {"error"}


def test_missing_column_is_an_error(spark):
    df = full(spark).drop("ListCost")
    found = [(r["rule"], r["column"]) for r in va.issues(df).collect()]
    assert found == [("missing_column", "ListCost")]
    assert va.verdict(df).first()["errors"] == 1


def test_schema_parity():
    want = focus.warehouse_schema()
    assert va.schema_parity(want) == []
    assert len(want) == 57 + 6 + 2
    problems = va.schema_parity(focus.spec_schema())
    assert "missing tag_owner" in problems and len(problems) == 8
