import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from spendframe.operators import validate as va
from spendframe.sources import files, payloads as pl, peek

A, B = dt.date(2024, 1, 1), dt.date(2024, 2, 1)


def write(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    return str(path)


CSV = "ChargePeriodStart,EffectiveCost,ProviderName,x_Internal\n"


def test_formats():
    assert files.file_format("s3://b/a.parq") == files.file_format("a.PQ") == "parquet"
    assert files.file_format("a.b/c") == files.file_format("c.txt") == "csv"
    assert files.file_format("c.csv", ".Parquet") == "parquet"


def test_focus_csv(spark, tmp_path):
    path = write(tmp_path / "f.csv", CSV + "2024-01-31 23:00:00,1.5,AWS,i\n2024-02-01,2,AWS,i\n2023-12-31,x,AWS,i\nbad,3,AWS,i\n")
    rows = files.focus_file(spark, path, A, B).collect()
    assert [(float(r["EffectiveCost"]), r["InvoiceIssuerName"], r["x_Internal"]) for r in rows] == [(1.5, "FOCUS file", "i")]


def test_unreadable_dates_reach_validation(spark, tmp_path):
    path = write(tmp_path / "f.csv", CSV + "soon,1,AWS,\nlater,2,AWS,\n")
    df = files.focus_file(spark, path, A, B)
    assert df.count() == 2
    assert va.issues(df).filter("rule = 'null' and column = 'ChargePeriodStart'").first()["n"] == 2


def test_parquet_parts_with_different_columns(spark, tmp_path):
    for i, df in enumerate([spark.createDataFrame([("2024-01-02", 1.0)], "ChargePeriodStart string, EffectiveCost double"),
                            spark.createDataFrame([("2024-01-03", "y")], "ChargePeriodStart string, x_tra string")]):
        df.write.parquet(str(tmp_path / "e" / f"part={i}"))
    out = files.aws_export(spark, str(tmp_path / "e"), A, B)
    assert out.count() == 2 and "x_tra" not in out.columns
    assert {(r["ProviderName"], r["InvoiceIssuerName"]) for r in out.collect()} == {("AWS", "Amazon Web Services")}


def test_azure_applies_the_range_and_keeps_given_providers(spark, tmp_path):
    path = write(tmp_path / "a.csv", CSV + "2024-01-02,1,Given,\n2024-01-03,1,,\n2024-03-01,1,,\n")
    out = files.azure_export(spark, path, A, B).collect()
    assert sorted(str(r["ProviderName"]) for r in out) == ["Given", "None"]


def test_gcp_table_filters_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "g.parquet")
    spark.sql("select timestamp_ntz'2024-01-05 00:00:00' ChargePeriodStart, 1.0 EffectiveCost union all "
              "select timestamp_ntz'2024-05-05 00:00:00', 2.0").write.parquet(path)
    out = files.gcp_export(spark.read.parquet(path), A, B)
    assert [r["ProviderName"] for r in out.collect()] == ["GCP"]
    assert "GreaterThanOrEqual(ChargePeriodStart" in out._jdf.queryExecution().executedPlan().toString()


def test_oci_reports(spark, tmp_path):
    root, head = tmp_path / "oci", "ChargePeriodStart,EffectiveCost,ProviderName\n"
    for day, provider in (("2023/12/31", "Oracle"), ("2024/01/01", " Oracle Cloud "), ("2024/01/31", "Other"), ("2024/02/01", "oci")):
        write(root / "FOCUS Reports" / day / "r-1.csv.gz", head + f"2024-01-01,1,{provider}\n", zipped=True)
    out = files.oci_reports(spark, str(root), A, B)
    assert sorted(r["ProviderName"] for r in out.collect()) == ["OCI", "Other"]
    assert files.oci_reports(spark, str(root), dt.date(2020, 1, 1), dt.date(2020, 2, 1)).count() == 0
    assert len(files.month_globs("r", dt.date(2023, 11, 5), B)) == 4


def test_csv_columns_go_by_name(spark, tmp_path):
    root = tmp_path / "oci" / "FOCUS Reports" / "2024/01"
    write(root / "01" / "a.csv.gz", "ChargePeriodStart,EffectiveCost,ListCost\n2024-01-01,1,10\n", zipped=True)
    write(root / "02" / "b.csv.gz", "ListCost,ChargePeriodStart,EffectiveCost\n20,2024-01-02,2\n", zipped=True)
    write(root / "03" / "c.csv.gz", "EffectiveCost,ChargePeriodStart\n3,2024-01-03\n", zipped=True)
    rows = files.oci_reports(spark, str(tmp_path / "oci"), A, B).collect()
    assert sorted((float(r["EffectiveCost"]), r["ListCost"] and float(r["ListCost"])) for r in rows) == [(1.0, 10.0), (2.0, 20.0), (3.0, None)]
    write(tmp_path / "f" / "a.csv", CSV + "2024-01-02,1,AWS,i\n")
    write(tmp_path / "f" / "b.csv", "ProviderName,ChargePeriodStart,EffectiveCost\nGCP,2024-01-03,2\n")
    rows = files.focus_file(spark, str(tmp_path / "f"), A, B).collect()
    assert sorted((r["ProviderName"], float(r["EffectiveCost"])) for r in rows) == [("AWS", 1.0), ("GCP", 2.0)]


def test_exports_read_only_their_months(spark, tmp_path):
    for month in (12, 1, 2, 3):
        spark.sql(f"select timestamp_ntz'2024-{month:02d}-05 00:00:00' ChargePeriodStart, 1.0 EffectiveCost, cast(null as string) ProviderName").write.parquet(
            str(tmp_path / "e" / f"BILLING_PERIOD=2024-{month:02d}"))
    out = files.aws_export(spark, str(tmp_path / "e"), A, dt.date(2024, 3, 1))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r["ChargePeriodStart"].date()), r["ProviderName"]) for r in out.collect()) == [("2024-01-05", "AWS"), ("2024-02-05", "AWS")]
    assert text.count("FileScan parquet") == 1 and text.count("GreaterThanOrEqual(ChargePeriodStart") == 1
    assert "2024-03" not in text.replace("2024-03-01", "")
    assert files.aws_export(spark, str(tmp_path / "e"), dt.date(2020, 1, 1), dt.date(2020, 2, 1)).count() == 0


def test_many_headers_are_read_in_tasks(spark, tmp_path, monkeypatch):
    """500 files with two headers: the driver opens none of them."""
    monkeypatch.setattr(files, "_header", lambda *_: pytest.fail("opened by the driver"))
    for i in range(500):
        text = f"ProviderName,EffectiveCost\r\nAWS,{i}\r\n" if i % 2 else f"\ufeffEffectiveCost,ProviderName\n{i},GCP\n"
        write(tmp_path / "some feed" / f"part {i}.csv{'.gz' if i % 5 == 0 else ''}", text, zipped=i % 5 == 0)
    rows = files.csv_by_name(spark, [str(tmp_path / "some feed")]).collect()
    assert sorted((int(r["EffectiveCost"]), r["ProviderName"]) for r in rows) == [(i, "AWS" if i % 2 else "GCP") for i in range(500)]


def test_headers_without_an_arrow_file_system(spark, tmp_path, monkeypatch):
    write(tmp_path / "a.csv", CSV + "2024-01-02,1,AWS,i\n")
    monkeypatch.setattr(files, "_uri", lambda _, file: "nosuchsystem://" + file)
    assert files.csv_by_name(spark, [str(tmp_path / "a.csv")]).count() == 1


def test_footers_tell_what_is_all_null(spark, tmp_path):
    sql = "select timestamp_ntz'2024-01-05 00:00:00' ChargePeriodStart, {} InvoiceIssuerName, {} ServiceProviderName"
    null = "cast(null as string)"
    cases = {"none": ("'i'", "'p'"), "all": (null, null), "mixed": ("if(id = 0, 'i', null)", "if(id = 1, 'p', null)")}
    for name, pair in cases.items():
        spark.sql(f"{sql.format(*pair)} from range(4)").write.parquet(str(tmp_path / name))
    names = ["InvoiceIssuerName", "ProviderName"]
    of = lambda *kinds: spark.read.option("mergeSchema", True).parquet(*[str(tmp_path / k) for k in kinds])
    assert peek.all_null(of("none"), names) == {n: False for n in names}
    assert peek.all_null(of("all"), names) == {n: True for n in names}
    assert peek.all_null(of("mixed"), names) == peek.all_null(of("none", "all"), names) == {}
    spark.range(3).write.parquet(str(tmp_path / "lacks"))
    assert peek.all_null(of("all", "lacks"), names) == {n: True for n in names}
    assert peek.all_null(of("none", "lacks"), names) == {} == peek.all_null(of("lacks"), names)
    for kind in cases:
        out = files.azure_export(spark, str(tmp_path / kind), A, B, "parquet")
        assert (out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1) == (kind != "mixed")
        want = {"none": ("i", "p"), "all": ("Microsoft", "Azure"), "mixed": (None, None)}[kind]
        assert want in {(r["InvoiceIssuerName"], r["ProviderName"]) for r in out.collect()}


def test_footers_without_statistics_leave_it_to_the_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    (tmp_path / "f").mkdir()
    pq.write_table(pa.table({"InvoiceIssuerName": pa.array([None, None], pa.string())}), tmp_path / "f" / "a.parquet", write_statistics=False)
    assert peek.all_null(spark.read.parquet(str(tmp_path / "f")), ["InvoiceIssuerName"]) == {}


def test_slices_and_chunks(spark):
    df = spark.createDataFrame([("b", dt.date(2024, 1, 15), dt.date(2024, 3, 1)), ("none", B, B)], "binding string, start date, end date")
    got = [(r["lo"], r["hi"]) for r in files.month_slices(df).orderBy("lo").collect()]
    assert got == [(dt.date(2024, 1, 15), B), (B, dt.date(2024, 3, 1))]
    assert files.date_chunks(A, dt.date(2024, 1, 6), 2) == [
        (dt.date(2024, 1, 1), dt.date(2024, 1, 3)), (dt.date(2024, 1, 3), dt.date(2024, 1, 5)), (dt.date(2024, 1, 5), dt.date(2024, 1, 6))]
    assert files.date_chunks(A, A, 2) == []


# --- payload documents as landed files ---------------------------------------------------------------
def landed(spark, tmp_path, doc, schema):
    return pl.read(spark, write(tmp_path / "p.json", json.dumps(doc, indent=1)), schema)


def test_cost_explorer(spark, tmp_path, one):
    doc = {"ResultsByTime": [{"TimePeriod": {"Start": "2024-01-03", "End": "2024-01-04"}, "Groups": [
        {"Keys": ["AWS Glue"], "Metrics": {"AmortizedCost": {"Amount": "2.5"}, "UnblendedCost": {"Amount": "3", "Unit": "EUR"}}}]},
        {"TimePeriod": {"Start": "2024-01-04", "End": "2024-01-05"}, "Groups": []}]}
    row = one(pl.aws_cost_explorer(landed(spark, tmp_path, doc, pl.SCHEMAS["aws_cost_explorer"]), A, B, "123"))
    assert (row["EffectiveCost"], row["ListCost"], row["ConsumedQuantity"], row["BillingCurrency"]) == (2.5, 3.0, 0.0, "EUR")
    assert (row["SubAccountId"], row["ServiceCategory"], row["BillingAccountName"]) == ("123", "Analytics", "AWS Account 123")
    assert row["BillingPeriodEnd"] == dt.datetime(2024, 2, 1)


def test_azure_query(spark, tmp_path):
    doc = {"properties": {"columns": [{"name": n} for n in ("PreTaxCost", "UsageDate", "ServiceName", "ResourceGroup")],
                          "rows": [[1.5, 20240105, "Key Vault", "rg"], [None, "2024-01-06T00:00:00", None, ""], [1, "soon", "x", "y"]]}}
    rows = pl.azure_query(landed(spark, tmp_path, doc, pl.SCHEMAS["azure_query"]), A, B).collect()
    assert [(r["EffectiveCost"], r["ServiceCategory"], r["ChargePeriodStart"].day, r["Tags"]) for r in rows] == [
        (1.5, "Security", 5, {"resource_group": "rg"}), (0.0, "Other", 6, {}), (1.0, "Other", 1, {"resource_group": "y"})]
    assert rows[1]["ServiceName"] == "Azure" and rows[2]["ChargePeriodEnd"] == dt.datetime(2024, 2, 1)


def test_gcp_detailed(spark, tmp_path, one):
    doc = {"billing_account_id": "", "service": {"description": "Cloud Run"}, "usage_start_time": "2024-01-05T00:00:00", "cost": 10,
           "credits": [{"amount": -2}, {"amount": -1.5}], "labels": [{"key": "a", "value": "1"}, {"key": "a", "value": "2"}]}
    row = one(pl.gcp_detailed(landed(spark, tmp_path, doc, pl.SCHEMAS["gcp_detailed"]), A, B))
    assert (row["EffectiveCost"], row["ListCost"], row["Tags"], row["BillingAccountId"]) == (6.5, 10.0, {"a": "2"}, "unknown")
    assert row["ChargePeriodEnd"] == dt.datetime(2024, 1, 6) and row["ServiceCategory"] == "Compute"


def test_cloudhealth_cube(spark, tmp_path):
    doc = {"dimensions": [{"time": [{"name": "total"}, {"name": "2024-01"}]}, {"AWS-Account": [{"label": "a1"}, {"name": "a2"}]}],
           "data": [[[[5.0]], [[0.0]]], [[[None]], [[7.5]]], [[[9.0]]]]}
    rows = pl.cloudhealth(landed(spark, tmp_path, doc, pl.SCHEMAS["cloudhealth"]), A, B).orderBy("EffectiveCost").collect()
    assert [(r["EffectiveCost"], r["BillingAccountId"], r["ServiceName"]) for r in rows] == [(5.0, "a1", "Unknown"), (7.5, "a2", "Unknown")]


def test_kubecost_list_and_object(spark, tmp_path):
    block = {"web": {"totalCost": 4, "totalEfficiency": 0.5}, "__idle__": {"totalCost": 1, "totalEfficiency": 9}}
    for data in ([block], block):
        rows = {r["ResourceId"]: r for r in pl.kubecost(landed(spark, tmp_path, {"data": data}, pl.SCHEMAS["kubecost"]), A, B).collect()}
        assert (rows["web"]["ConsumedQuantity"], rows["web"]["Tags"]) == (0.5, {"namespace": "web"})
        assert (rows["__idle__"]["ConsumedQuantity"], rows["__idle__"]["ResourceType"]) == (0.0, "Idle")


def test_flat_fallbacks(spark, tmp_path, one):
    doc = {"costs": [{"amount": "", "cost": "2", "provider": "gcp", "date": "2024-01-07"}]}
    row = one(pl.flat_costs(landed(spark, tmp_path, doc, pl.flat_schema("vantage")), "vantage", A, B))
    assert (row["BilledCost"], row["BillingAccountId"], row["BillingAccountName"], row["ServiceName"]) == (2.0, "GCP", "GCP", "Unknown")
    doc = {"results": [{"amortized_cost": 1, "unblended_cost": 0, "vendor": "aws"}]}
    row = one(pl.flat_costs(landed(spark, tmp_path, doc, pl.flat_schema("cloudability")), "cloudability", A, B))
    assert (row["EffectiveCost"], row["BilledCost"], row["ListCost"], row["ContractedCost"]) == (1.0, 0.0, 0.0, 1.0)
    doc = {"costs": [], "data": [{"real_cost": 3, "element": "e"}]}
    row = one(pl.flat_costs(landed(spark, tmp_path, doc, pl.flat_schema("cloudzero")), "cloudzero", A, B))
    assert (row["EffectiveCost"], row["ChargeDescription"], row["ChargePeriodStart"]) == (3.0, "e", dt.datetime(2024, 1, 1))


@pytest.mark.parametrize("vendor", list(pl.FLAT))
def test_flat_feeds_can_pass_the_period_checks(spark, vendor):
    spec = pl.FLAT[vendor]
    record = {k: "5" for k in (*spec.effective, *spec.provider, *spec.account, *spec.account_name, *spec.service)}
    rows = spark.createDataFrame([(record,)], "r map<string,string>")
    from spendframe.operators import normalize as nz
    found = {r["column"] for r in va.issues(nz.normalize(pl.flat_records(rows, spec, A, B))).filter("severity = 'error'").collect()}
    assert found == set()


def test_finout_zero_falls_back(spark, tmp_path, one):
    doc = {"data": [{"amortizedCost_sum": {"amount": 4, "unit": "USD"}, "unblendedCost_sum": {"amount": 0}, "listCost_sum": 6,
                     "_billing_dimension_provider": "aws"}]}
    row = one(pl.finout(landed(spark, tmp_path, doc, f"data array<{pl.RECORD}>"), A, B))
    assert (row["BilledCost"], row["EffectiveCost"], row["ListCost"], row["ProviderName"]) == (4.0, 4.0, 6.0, "AWS")


def test_recommendation_shapes(spark, tmp_path, one):
    rec = {"RightsizingRecommendations": [
        {"AccountId": "a", "CurrentInstance": {"ResourceId": "i-1"}, "RightsizingType": "MODIFY", "ModifyRecommendationDetail": {
            "TargetInstances": [{"EstimatedMonthlySavings": "3"}, {"EstimatedMonthlySavings": "9"}]}},
        {"CurrentInstance": {"ResourceId": "i-2"}, "RightsizingType": "TERMINATE",
         "TerminateRecommendationDetail": {"EstimatedMonthlySavings": "7"}},
        {"RightsizingType": "MODIFY"}]}
    schema = ("RightsizingRecommendations array<struct<AccountId: string, RightsizingType: string, CurrentInstance: struct<ResourceId: string>, "
              "ModifyRecommendationDetail: struct<TargetInstances: array<struct<EstimatedMonthlySavings: string>>>, "
              "TerminateRecommendationDetail: struct<EstimatedMonthlySavings: string>>>")
    rows = pl.aws_rightsizing(landed(spark, tmp_path, rec, schema)).collect()
    assert [(r["estimated_monthly_savings"], r["lever"]) for r in rows] == [(9.0, "rightsizing"), (7.0, "idle_resource"), (0.0, "rightsizing")]
    item = {"vendor": "aws", "service": "ec2", "result": [{"resourceId": "i", "recommendations": [{"savings": "4"}, {"savings": "8"}]}, {}]}
    schema = f"vendor string, service string, {{}} array<struct<resourceIdentifier: string, resourceId: string, recommendations: array<{pl.RECORD}>>>"
    schema = ", ".join([schema.format("result"), schema.format("results").split("string, ", 2)[2]])
    rows = pl.cloudability_rightsizing(landed(spark, tmp_path, item, schema)).collect()
    assert [(r["estimated_monthly_savings"], r["resource_id"], r["cloud"]) for r in rows] == [(4.0, "i", "AWS"), (0.0, "", "AWS")]
    turbo = {"actionType": "RESIZE", "target": {"uuid": "u", "className": "VM", "environmentType": "cloud"}, "savingsAmount": "5",
             "risk": {"severity": "MAJOR"}}
    schema = (f"actionType string, details string, target {pl.RECORD}, currentEntity {pl.RECORD}, savingsAmount string, risk struct<severity: string>")
    row = one(pl.turbonomic(landed(spark, tmp_path, turbo, schema)))
    assert (row["cloud"], row["resource_type"], row["lever"], row["action"], row["risk"]) == ("CLOUD", "VM", "resize", "RESIZE", "Major")


@pytest.mark.parametrize("vendor,record,want", [
    ("cloudhealth", {"cloud": "aws", "estimatedMonthlySavings": "2"}, ("AWS", "rightsizing", "Rightsize", 2.0)),
    ("harness", {"monthlySavings": "3", "recommendationType": "NODE"}, ("", "NODE", "Harness CCM recommendation", 3.0)),
    ("nops", {"savings": "4", "lever": "compute-copilot"}, ("AWS", "compute-copilot", "Optimize", 4.0)),
    ("vantage", {"potential_savings": "5", "description": "d"}, ("", "rightsizing", "d", 5.0)),
    ("finout", {"groupYearlyPotentialSavings": "24"}, ("", "rightsizing", "CostGuard recommendation", 2.0))])
def test_flat_findings(spark, one, vendor, record, want):
    containers = pl.FLAT_FINDINGS[vendor].containers
    df = spark.createDataFrame([([record],) * len(containers)], ", ".join(f"{c} array<{pl.RECORD}>" for c in containers))
    row = one(pl.flat_findings(df, vendor))
    assert (row["cloud"], row["lever"], row["action"], row["estimated_monthly_savings"]) == want


def test_cloud_budgets(spark, tmp_path, one):
    for cloud, doc in {"AWS": {"Budgets": [{"BudgetName": "b", "BudgetLimit": {"Amount": "12.5"}}]},
                       "Azure": {"value": [{"name": "b", "properties": {"amount": 12.5}}]},
                       "GCP": {"budgets": [{"displayName": "b", "amount": {"specifiedAmount": {"units": "12", "nanos": 500000000}}}]},
                       "OCI": {"items": [{"display_name": "b", "amount": 12.5}]}}.items():
        container = pl.CLOUD_BUDGETS[cloud][0]
        df = landed(spark, tmp_path, doc, f"{container} array<{pl.RECORD}>")
        assert one(pl.cloud_budgets(df, cloud, dt.date(2024, 5, 9))) == {
            "period": dt.date(2024, 5, 1), "cloud": cloud, "application": "b", "budget": 12.5}
