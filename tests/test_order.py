"""Ranks and order statistics by key against sorting, and their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import order, prepare, resample
from tessella.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, values are tied, one key has a single row."""
    rng = random.Random(6)
    data = [("hot", rng.randint(0, 40) / 4.0) for _ in range(5000)] + [("few", rng.random()) for _ in range(11)] + [("one", 3.5)] + [("even", float(v)) for v in (4, 1, 3, 2)] + [("null", None)]
    return materialize(spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id bigint, k string, v double").repartition(7))


def by_key(rows):
    out = {}
    for r in rows.where("v is not null").collect():
        out.setdefault(r["k"], []).append((r["v"], r["id"]))
    return {k: sorted(v) for k, v in out.items()}


def test_ranks_within_keys(rows):
    got = order.ranked(rows.where("v is not null"), ("k",), ["v", "id"]).collect()
    want = {(k, i): at + 1 for k, v in by_key(rows).items() for at, (_, i) in enumerate(v)}
    assert {(r["k"], r["id"]): r["rank"] for r in got} == want


def test_medians(rows):
    got = {r["k"]: r["median"] for r in order.medians(rows, ("k",)).collect()}
    for k, v in by_key(rows).items():
        assert got[k] == (v[(len(v) - 1) // 2][0] + v[len(v) // 2][0]) / 2
    assert set(got) == set(by_key(rows))


@pytest.mark.parametrize("size", [1, 2, 700, 5000, 9000])
def test_smallest_rows_of_every_key(rows, size):
    some = rows.where("k = 'hot' or k = 'few'")
    got = {(r["k"], r["id"]) for r in order.smallest(some, ("k",), "v", size, 5000).collect()}
    assert {x for x in got if x[0] == "hot"} == {("hot", i) for _, i in by_key(rows)["hot"][:size]}


def test_order_statistics_at_any_share(rows):
    values = by_key(rows)["hot"]
    for share in (0.0, 0.013, 0.5, 0.87, 1.0):
        at = {"x": lambda n, s=share: F.floor((n - 1) * s)}
        got = order.order_statistics(rows.where("k = 'hot'"), (), share, at).first()
        want = values[int(4999 * share)][0]
        assert got["x"] == want and got["before_x"] == sum(v < want for v, _ in values) and got["n"] == 5000


def test_no_window_or_buffer_holds_a_key(spark, example):
    """Windows are over ranges, distinct values inside the bracket, or rows at the cut; no exact percentile."""
    cases = materialize(example.select(F.col("n").alias("id"), "Stress", "Support"))
    frames = [resample.subsample(cases, 40, 3), resample.halves(cases, 150), prepare.scale_model(cases, ["Stress"], "robust"), resample.permuted(resample.indexed(cases.select("id", "Stress"), "id"), ["Stress"], 2)]
    for df in frames:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"\b(median|percentile)\(", plan)
        for spec in re.findall(r"Window \[.*?\], \[(.*?)\]", plan):
            assert any(name in spec for name in ("_p#", "_u#", "_h#", "Variable#", "replicate#")), spec
    assert resample.subsample(cases, 40, 3).groupBy("replicate").count().where("count <> 40").isEmpty()


def test_large_whole_numbers_are_exact(spark):
    rows = spark.range(3000).select("id", (F.lit(2**59) + F.pmod(F.xxhash64("id"), F.lit(400))).alias("u"))
    want = sorted((r["u"], r["id"]) for r in rows.collect())[:1234]
    assert sorted((r["u"], r["id"]) for r in order.smallest(rows, (), "u", 1234, 3000).collect()) == want
