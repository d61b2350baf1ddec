"""Totals beside the rows of a report, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spendframe.functions.totals import beside_totals, largest
from spendframe.operators import rollups as ru


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(5)
    out = [(f"k{i}", dice.choice([None, 1, 2, 2, 7]), dice.choice(["a", "b", None])) for i in range(300)]
    return out + [(None, 11, "c")]


def test_totals_stand_beside_every_row(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long, other string")
    out = beside_totals(df, ["k"], {"sum": F.sum("v"), "others": F.array_sort(F.collect_set("other")), "n": F.count("k")}, 7)
    got = sorted(map(tuple, out.collect()), key=str)
    total = sum(v or 0 for _, v, _ in rows)
    assert got == sorted([(*r, total, ["a", "b", "c"], 300) for r in rows], key=str)
    assert beside_totals(df.limit(0), ["k"], {"sum": F.sum("v")}).collect() == []


def test_two_keys(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long, other string").groupBy("v", "other").agg(F.count("k").alias("n"))
    got = beside_totals(df, ["v", "other"], {"all": F.sum("n")}).collect()
    assert len(got) == len({r[1:] for r in rows}) and {r["all"] for r in got} == {300}


@pytest.mark.parametrize("k", [0, 1, 5, 299, 400])
def test_largest_with_ties_and_nulls(spark, rows, k):
    known = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(known, "k string, v long, other string").drop("other")
    order = [r[0] for r in sorted(known, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    got = largest(df, "k", "v", k, 4).collect()
    assert len(got) == 300 and {r["labels"] for r in got} == {300}
    assert all(r["largest"] == order[:k] for r in got)


@pytest.mark.parametrize("limit", [1, 3, 300, 301])
def test_fold_keeps_the_sum(spark, rows, limit):
    df = spark.createDataFrame(rows, "k string, cost long, other string").drop("other")
    got = {(r["k"], r["folded"]): r["cost"] for r in ru.fold_tail(df, "k", limit).collect()}
    assert sum(v or 0 for v in got.values()) == sum(r[1] or 0 for r in rows if r[0] is not None)
    assert len(got) == (limit if limit < 300 else 300)
