import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spendframe.functions import focus
from spendframe.operators import validate as va
from spendframe.operators.scope import Scope
from spendframe.plans import nightly, sinks
from spendframe.sources import warehouse as wh

NOW = dt.datetime(2024, 3, 10, 3, 15)
FULL = dict(
    BillingAccountId="a", BillingAccountName="a", BillingCurrency="USD", BillingPeriodStart="2024-01-01",
    BillingPeriodEnd="2024-02-01", InvoiceIssuerName="i", ChargeCategory="Usage", ChargeDescription="d", BilledCost="1",
    EffectiveCost="1", ListCost="1", ContractedCost="1", ProviderName="AWS", ServiceCategory="Compute", ServiceName="VM",
    Tags='{"app": "shop"}')


def feed(days, **fields):
    """A binding whose feed has one row per given day."""
    def read(spark, start, end):
        df = spark.createDataFrame([(d,) for d in days], "ChargePeriodStart string")
        df = df.withColumns({k: F.lit(v) for k, v in {**FULL, **fields}.items()})
        df = df.withColumn("ChargePeriodEnd", F.date_add("ChargePeriodStart", 1).cast("string"))
        return df.filter((F.col("ChargePeriodStart") >= str(start)) & (F.col("ChargePeriodStart") < str(end)))
    return read


@pytest.fixture
def run(spark, tmp_path):
    def go(**bindings):
        return nightly.ingest(spark, bindings, str(tmp_path / "landing"), str(tmp_path / "charges"),
                              dt.date(2024, 1, 1), dt.date(2024, 3, 10), NOW)
    go.path = str(tmp_path / "charges")
    go.days = lambda: sorted((r["_binding"], str(r["charge_date"])) for r in wh.table(spark, go.path).collect())
    return go


def missing(spark, start, end):
    return spark.read.parquet("/no/such/feed")


def test_bad_bindings_are_isolated(run, spark):
    results = {r.binding: r for r in run(
        good=feed(["2024-01-05", "2024-01-06"]), gone=missing, empty=feed(["2020-01-01"]),
        broken=feed(["2024-01-05", "2024-02-05"], ServiceCategory="Nonsense"))}
    assert {k: (r.status, r.rows) for k, r in results.items()} == {
        "good": ("loaded", 2), "gone": ("failed", 0), "empty": ("empty", 0), "broken": ("failed", 0)}
    assert "enum ServiceCategory" in results["broken"].reason
    assert nightly.exit_code(list(results.values())) == 0
    table = wh.table(spark, run.path)
    assert run.days() == [("good", "2024-01-05"), ("good", "2024-01-06")]
    row = table.first()
    assert (row["tag_application"], row["_ingested_at"], row["ChargeClass"]) == ("shop", NOW, None)


def corrupt(folder):
    """A binding whose file can be listed but not read."""
    def read(spark, start, end):
        spark.range(1).selectExpr("'2024-01-05' AS ChargePeriodStart").write.mode("overwrite").parquet(folder)
        schema = spark.read.parquet(folder).schema
        for file in Path(folder).glob("part-*"):
            file.write_bytes(b"PAR1 not a file PAR1")
        return spark.read.schema(schema).parquet(folder)
    return read


def test_a_feed_that_fails_while_read_fails_alone(run, tmp_path):
    results = {r.binding: r.status for r in run(bad=corrupt(str(tmp_path / "c")), good=feed(["2024-01-05"]))}
    assert results == {"bad": "failed", "good": "loaded"} and run.days() == [("good", "2024-01-05")]
    results = run(bad=corrupt(str(tmp_path / "c")))
    assert nightly.exit_code(results) == 1 and run.days() == [("good", "2024-01-05")]


def test_a_reader_sees_the_table_before_or_after(run, spark, monkeypatch):
    run(a=feed(["2024-01-05", "2024-01-06"]))
    before = wh.table(spark, run.path)
    monkeypatch.setattr(sinks.Manifests, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        run(a=feed(["2024-01-06"]))
    assert len(run.days()) == 2 and len(sinks.Manifests(spark, run.path).folders()) == 1
    monkeypatch.undo()
    run(a=feed(["2024-01-06", "2024-01-07"]))
    assert before.count() == 2  # an open reader keeps its version
    assert run.days() == [("a", "2024-01-05"), ("a", "2024-01-06"), ("a", "2024-01-07")]
    run(a=feed(["2024-01-05", "2024-01-07"]))
    assert run.days() == [("a", "2024-01-05"), ("a", "2024-01-07")]
    assert len(sinks.Manifests(spark, run.path).latest()[1]) == 1  # covered versions are forgotten
    assert len(sinks.vacuum(spark, run.path)) == 2 and len(run.days()) == 2


def test_two_writers_do_not_lose_each_other(run, spark):
    run(a=feed(["2024-01-05"]))
    manifests = sinks.Manifests(spark, run.path)
    number, versions = manifests.latest()
    manifests.publish(number + 1, versions)
    with pytest.raises(OSError):
        manifests.publish(number + 1, [])
    assert len(run.days()) == 1


def test_writers_at_the_same_time_keep_all_windows(run, spark):
    """Eight runs replace a binding each; whoever comes second at a manifest number reads again and takes the next."""
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: run(**{f"b{i}": feed([f"2024-01-0{i + 1}"])}), range(8)))
    assert all(r.status == "loaded" for results in done for r in results)
    assert run.days() == [(f"b{i}", f"2024-01-0{i + 1}") for i in range(8)]
    assert sinks.Manifests(spark, run.path).latest()[0] == 8


def test_a_writer_that_comes_second_reads_again(run, spark, monkeypatch):
    publish, others = sinks.Manifests.publish, [feed(["2024-01-07"])]

    def late(self, number, versions):
        if others:
            run(other=others.pop())
        return publish(self, number, versions)

    monkeypatch.setattr(sinks.Manifests, "publish", late)
    run(own=feed(["2024-01-05"]))
    assert run.days() == [("other", "2024-01-07"), ("own", "2024-01-05")]


def test_a_feed_that_raises_its_own_error_fails_alone(run):
    def strange(spark, start, end):
        return {}["account"]

    results = {r.binding: r.status for r in run(bad=strange, good=feed(["2024-01-05"]))}
    assert results == {"bad": "failed", "good": "loaded"} and run.days() == [("good", "2024-01-05")]


def test_all_failed_replaces_nothing(run):
    run(good=feed(["2024-01-05"]))
    results = run(gone=missing, good=feed(["2024-01-06"], EffectiveCost=None))
    assert nightly.exit_code(results) == 1 and nightly.exit_code([]) == 0
    assert run.days() == [("good", "2024-01-05")]


def test_rerun_is_idempotent_and_drops_vanished_days(run):
    run(a=feed(["2024-01-05", "2024-01-06", "2024-01-07"]))
    run(a=feed(["2024-01-05", "2024-01-06", "2024-01-07"]))
    assert len(run.days()) == 3
    run(a=feed(["2024-01-05", "2024-01-07"]))
    assert run.days() == [("a", "2024-01-05"), ("a", "2024-01-07")]


def test_ranges_are_per_binding(run):
    run(a=feed(["2024-01-05", "2024-02-05"]), b=feed(["2024-01-05", "2024-02-05"]))
    run(a=feed(["2024-01-05", "2024-02-05"]), b=feed(["2024-02-05"]))
    assert ("b", "2024-01-05") in run.days() and len(run.days()) == 4


def test_binding_names_need_no_care(run):
    run(**{"payer/1 = x": feed(["2024-01-05"]), "7": feed(["2024-01-05"])})
    run(**{"payer/1 = x": feed(["2024-01-05"]), "7": feed(["2024-01-05"])})
    assert run.days() == [("7", "2024-01-05"), ("payer/1 = x", "2024-01-05")]


def test_reads_are_bounded_and_guarded(run, spark):
    run(a=feed(["2024-01-05", "2024-02-05", "2024-03-05"]))
    one_day = wh.read_charges(spark, run.path, Scope(dt.date(2024, 3, 1), dt.date(2024, 3, 9)), NOW.date())
    assert one_day.count() == 1
    assert 0 < wh.scanned_bytes(one_day) < wh.scanned_bytes(wh.table(spark, run.path))
    assert wh.read_charges(spark, run.path, Scope(), NOW.date()).count() == 3
    assert wh.read_charges(spark, run.path, Scope(), dt.date(2026, 4, 1)).count() == 1
    with pytest.raises(ValueError):
        wh.read_charges(spark, run.path, Scope(), NOW.date(), max_bytes=10)


def test_table_schema(run, spark):
    run(a=feed(["2024-01-05"]))
    stored = wh.table(spark, run.path).drop("charge_date")
    want = {f.name: f.dataType for f in focus.warehouse_schema()}
    assert {f.name: f.dataType for f in stored.schema} == want
    assert not [p for p in va.schema_parity(stored.schema) if "nullable" not in p]


def test_landing_keeps_types_of_empty_columns(spark, tmp_path):
    rows = nightly.prepare(feed(["2024-01-05"])(spark, dt.date(2024, 1, 1), dt.date(2024, 2, 1)), "b", NOW)
    sinks.write_landing(rows, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).schema["ListUnitPrice"].dataType.simpleString() == "decimal(28,9)"


def test_snapshot_replaces_one_day(run, spark, tmp_path):
    target = str(tmp_path / "opps")
    run(a=feed(["2024-01-05"], CommitmentDiscountId="c", CommitmentDiscountType="t", CommitmentDiscountStatus="Unused", EffectiveCost="500"))
    for day in (9, 10, 10):
        nightly.opportunities(spark, run.path, target, dt.datetime(2024, 3, day, 3, 45))
    rows = wh.latest_snapshot(spark, target).collect()
    assert {str(r["as_of"]) for r in rows} == {"2024-03-10"} and len(rows) == len({(r["lever_id"], r["cloud"]) for r in rows})
    assert wh.latest_snapshot(spark, target, ("AWS", "x")).count() == len(rows)
    assert wh.latest_snapshot(spark, target, ("AW",)).count() == 0
    # No charges in the window any more: the day is emptied, the day before is the latest.
    nightly.opportunities(spark, run.path, target, dt.datetime(2024, 3, 10, 4))
    sinks.replace_snapshot(spark, wh.latest_snapshot(spark, target).limit(0), target, dt.date(2024, 3, 10))
    assert {str(r["as_of"]) for r in wh.latest_snapshot(spark, target).collect()} == {"2024-03-09"}


def test_lookback():
    assert nightly.lookback(dt.date(2024, 3, 10)) == (dt.date(2024, 1, 1), dt.date(2024, 3, 10))
    assert nightly.lookback(dt.date(2024, 1, 31))[0] == dt.date(2023, 11, 1)
