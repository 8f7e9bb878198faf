from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dealgrain.operators import scale
from dealgrain.session import materialise, work_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """Four groups, one with two thirds of the rows, a null group, ties, negatives and nulls."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        key = rng.choice(["hot"] * 8 + ["a", "b", None, "c"])
        value = rng.choice([None, 5.0, rng.uniform(-50, 50), rng.uniform(1e8, 9e8), rng.uniform(0, 1)])
        rows.append((i, key, value))
    return rows, spark.createDataFrame(rows, "i long, k string, v double")


def test_quantiles_of_groups(skewed):
    rows, df = skewed
    q = {"m": scale.Quantile(F.col("v")), "q": scale.Quantile(F.col("v"), 0.98), "cond": scale.Quantile(F.when(F.col("v") > 0, F.col("v")), 0.25)}
    got = scale.group_quantiles(df, ["k"], q, {"n": F.count(F.lit(1))}).collect()
    pdf = pd.DataFrame(rows, columns=["i", "k", "v"]).astype({"v": "float64"})
    assert len(got) == 5
    for r in got:
        part = pdf[pdf.k.isna()] if r.k is None else pdf[pdf.k == r.k]
        known = part.v.dropna()
        assert r.n == len(part)
        assert np.isclose(r.m, known.median(), rtol=1e-14) and np.isclose(r.q, known.quantile(0.98), rtol=1e-12)
        assert np.isclose(r.cond, known[known > 0].quantile(0.25), rtol=1e-12)


def test_quantiles_of_the_whole_table(skewed):
    rows, df = skewed
    got = scale.group_quantiles(df, [], {"m": scale.Quantile(F.col("v"))}, {"n": F.count(F.lit(1))}).collect()
    assert len(got) == 1 and got[0].n == 3000
    assert np.isclose(got[0].m, np.median([v for _, _, v in rows if v is not None]), rtol=1e-14)


def test_quantiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert scale.group_quantiles(empty, ["k"], {"m": scale.Quantile(F.col("v"))}).count() == 0
    assert scale.group_quantiles(empty, [], {"m": scale.Quantile(F.col("v"))}).collect()[0].m is None


def test_ranks_match_pandas(skewed):
    rows, df = skewed
    pdf = pd.DataFrame(rows, columns=["i", "k", "v"]).astype({"v": "float64"}).set_index("i")
    ranked = scale.with_percent_rank(scale.with_rank(df, ["k"], "v", "r"), ["k"], "v", "p").toPandas().set_index("i").sort_index()
    groups = pdf.groupby("k", dropna=False).v
    want = groups.rank(method="min", ascending=False)
    assert np.array_equal(ranked.r.astype("float64").to_numpy(), want.to_numpy(), equal_nan=True)
    assert np.allclose(ranked.p.astype("float64"), groups.rank(pct=True), equal_nan=True)


def test_row_numbers_follow_the_whole_order(spark):
    values = random.Random(2).sample(range(10_000), 2000)
    df = spark.createDataFrame([(v // 100, v) for v in values], "a long, b long").repartition(7)
    got = scale.with_row_number(df, [F.desc("a"), F.asc("b")], "n").orderBy("n").collect()
    want = sorted(((v // 100, v) for v in values), key=lambda t: (-t[0], t[1]))
    assert [(r.a, r.b) for r in got] == want and [r.n for r in got] == list(range(1, 2001))


def test_pick_row_keeps_whole_rows_and_null_keys(spark):
    df = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), (None, 1, "n")], "k string, o int, v string")
    assert {(r.k, r.v) for r in scale.pick_row(df, ["k"], [F.col("o")], last=True).collect()} == {("x", "new"), (None, "n")}
    assert {(r.k, r.v) for r in scale.pick_row(df, ["k"], [F.col("o")]).collect()} == {("x", "old"), (None, "n")}


def test_unknown_and_infinite_values_have_one_answer_in_any_group(spark):
    odd = [-5.0, 1.0, 2.0, 3.0, float("nan"), None]
    rows = [("small", v) for v in odd] + [("crowded", v) for v in odd * 400] + [("wide", v) for v in [float("inf"), float("-inf"), 1.0, 2.0, float("nan")]]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in scale.group_quantiles(df, ["k"], {"m": scale.Quantile(F.col("v"))}).collect()}
    assert got == {"small": 1.5, "crowded": 1.5, "wide": 1.5}
    ends = scale.group_quantiles(df.where("k = 'wide'"), [], {"a": scale.Quantile(F.col("v"), 0.0), "b": scale.Quantile(F.col("v"), 1.0)}).first()
    assert (ends.a, ends.b) == (float("-inf"), float("inf"))
    ranked = {r.v: r.r for r in scale.with_rank(df.where("k = 'small'"), ["k"], "v", "r").collect() if r.v == r.v}
    assert ranked == {3.0: 1, 2.0: 2, 1.0: 3, -5.0: 4, None: None}


def test_quantiles_run_nothing_before_they_are_asked_for(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    scale.group_quantiles(skewed[1], ["k"], {"m": scale.Quantile(F.col("v"))})
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_materialised_tables_live_in_the_named_folder(spark):
    df = materialise(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5
    assert work_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(work_folder(spark) in f for f in df.inputFiles())


@pytest.mark.parametrize("few", [1 << 16, 100, 0])
def test_stored_quantiles_of_few_and_many_rows(skewed, monkeypatch, few):
    rows, df = skewed
    monkeypatch.setattr(scale, "FEW_ROWS", few)
    q = {"m": scale.Quantile(F.col("v")), "q": scale.Quantile(F.col("v"), 0.98), "cond": scale.Quantile(F.when(F.col("v") > 0, F.col("v")), 0.25)}
    got = scale.group_quantiles(df, ["k"], q, {"n": F.count(F.lit(1))}, stored=True)
    pdf = pd.DataFrame(rows, columns=["i", "k", "v"]).astype({"v": "float64"})
    found = got.collect()
    assert got.columns == ["k", "n", "m", "q", "cond"] and len(found) == 5
    for r in found:
        part = pdf[pdf.k.isna()] if r.k is None else pdf[pdf.k == r.k]
        known = part.v.dropna()
        assert r.n == len(part)
        assert np.isclose(r.m, known.median(), rtol=1e-14) and np.isclose(r.q, known.quantile(0.98), rtol=1e-12)
        assert np.isclose(r.cond, known[known > 0].quantile(0.25), rtol=1e-12)
    alone = scale.known_quantiles(df, ["k"], {"m": q["m"]}, stored=True).collect()
    assert {(r.k, r.m) for r in alone} == {(r.k, r.m) for r in found}


def test_small_groups_are_dealt_once(skewed):
    plan = scale.group_quantiles(skewed[1], ["k"], {"m": scale.Quantile(F.col("v"))}, {"n": F.count(F.lit(1))}, stored=True)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_of_small_groups_are_dealt_as_they_are(skewed):
    plan = scale.group_quantiles(skewed[1], ["k"], {"m": scale.Quantile(F.col("v"))}, {"n": F.count(F.lit(1))}, stored=True)
    below = plan._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1]
    assert "Aggregate" not in below
