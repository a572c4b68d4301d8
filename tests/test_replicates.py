"""Bootstrap samples with a row for each drawn case against samples with a row for each draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import kmeans, resample
from tessella.session import indexed, materialize


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.5, (20, 2)) for m in ((0, 0), (3, 0), (0, 4))])
    cases = materialize(spark.createDataFrame([(i + 1, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>"))
    return cases, resample.drawn_replicates(cases, 4), resample.counted_replicates(cases, 4)


def rows(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_counts_are_those_of_the_draws(spark, drawn):
    cases, each, counted = drawn
    assert rows(counted, "replicate", "id", "n") == rows(each.groupBy("replicate", "case").count(), "replicate", "case", "count")
    plan = resample.bootstrap_counts(materialize(indexed(cases)), 60, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "explode" not in plan.lower()


def test_lloyd_rounds_with_copies(spark, drawn):
    cases, each, counted = drawn
    seeds = materialize(kmeans.random_seeds(counted, 3, 2, 7, ("replicate",), "n").withColumn("start", F.col("start") - 2))
    assert seeds.groupBy("replicate", "start").count().where("count <> 3").isEmpty()

    def settled(rows, copies):
        passes = kmeans.CentrePasses(rows, seeds, ("replicate",), ("replicate", "start"), 2, copies)
        passes.settle(20, kmeans.STILL)
        n, ss, _ = passes.add_up(np.arange(len(passes.slots)))
        return passes.values, n, ss

    for a, b in zip(settled(each, None), settled(counted, "n")):
        assert a == pytest.approx(b)
    grown = kmeans.plus_plus_seeds(counted, 3, 2, 9, ("replicate",), "n")
    assert grown.count() == 4 * 2 * 3 and grown.select("replicate", "start", "center").distinct().count() == 24


def test_measures_with_copies(spark, drawn):
    cases, each, counted = drawn
    label = lambda c: (F.pmod(F.xxhash64("replicate", c), F.lit(3)) + 1).cast("int").alias("cluster")
    original = cases.select("id", (F.col("id") % 3 + 1).cast("int").alias("cluster"))
    long = materialize(each.select("replicate", "id", "case", "x", label("case")))
    short = materialize(counted.select("replicate", "id", "n", "x", label("id")))
    by_case = long.select("replicate", F.col("case").alias("id"), "cluster")
    assert rows(resample.cluster_jaccard(original, short), "replicate", "cluster", "Jaccard") == pytest.approx(rows(resample.cluster_jaccard(original, by_case), "replicate", "cluster", "Jaccard"))
    for c in ("ARI", "Rand"):
        assert rows(resample.replicate_agreement(original, short), "replicate", c) == pytest.approx(rows(resample.replicate_agreement(original, by_case), "replicate", c))
    assert rows(resample.replicate_silhouettes(short), "replicate", "Silhouette") == pytest.approx(rows(resample.replicate_silhouettes(long), "replicate", "Silhouette"))
