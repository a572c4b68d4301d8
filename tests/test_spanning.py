"""Single linkage by blocks against the tree of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import ClusterConfig
from tessella.functions import distance as dist
from tessella.operators import agreement, linkage, spanning
from tessella.plans import jobs
from tessella.session import materialize


def crowd(spark, n=500, seed=3, copies=60, digits=2):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 0.4, (n // 4, 3)) for m in ((0, 0, 0), (3, 0, 1), (0, 4, 2), (9, 9, 9))]).round(digits)
    x[:copies] = x[0]
    x = x[rng.permutation(len(x))]
    return materialize(spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>"))


@pytest.mark.parametrize("name", spanning.BOXED)
def test_tree_is_that_of_all_pairs(spark, name):
    """Many copies, and distances that are equal: the very same edges."""
    cases = crowd(spark, digits=1 if name == "maximum" else 2)
    trace = []
    got = sorted(map(tuple, spanning.block_tree(cases, name, block=40, trace=trace).collect()))
    x = np.array([r["x"] for r in cases.orderBy("id").collect()])
    n, d = len(x), spanning.matrices.matrix(name, x, x)
    up = list(range(n))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    expected = []
    for height, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            expected.append((i, j, height))
    assert got == sorted(expected)
    assert sum(t["asked"] for t in trace) < 0.5 * sum(t["all"] for t in trace)


def test_far_blocks_are_not_asked(spark):
    rng = np.random.default_rng(8)
    cases = materialize(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(rng.random((4000, 2)))], "id bigint, x array<double>"))
    trace = []
    made = spanning.block_tree(cases, block=100, trace=trace)
    assert made.count() == 3999
    assert all(b["components"] <= a["components"] / 2 for a, b in zip(trace, trace[1:]))
    assert sum(t["asked"] for t in trace) < 0.05 * sum(t["all"] for t in trace)


def test_small_and_odd_tables(spark):
    schema = "id string, x array<double>"
    assert spanning.block_tree(spark.createDataFrame([], schema)).count() == 0
    assert spanning.block_tree(spark.createDataFrame([("a", [1.0])], schema)).count() == 0
    same = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [1.0])], schema)
    assert sorted(map(tuple, spanning.block_tree(same).collect())) == [("a", "b", 0.0), ("a", "c", 0.0)]
    text = spark.createDataFrame([(c, [float(v)]) for c, v in zip("dacb", (0, 5, 1, 7))], schema)
    assert sorted(map(tuple, spanning.block_tree(text, block=2).collect())) == [("a", "b", 2.0), ("a", "c", 4.0), ("c", "d", 1.0)]
    with pytest.raises(ValueError, match="no bound"):
        spanning.block_tree(same, "cosine")


def test_last_merges(spark):
    cases = crowd(spark, n=120, copies=5)
    ids = cases.select("id")
    tree = materialize(spanning.block_tree(cases, block=20))
    merges = spanning.last_merges(tree, ids, 30).orderBy("stage").collect()
    heights = sorted(r["height"] for r in tree.collect())
    assert [r["height"] for r in merges] == heights[-29:] and merges[-1]["n"] == 30
    undone = spark.createDataFrame([(r["a"], r["b"], r["height"]) for r in merges], "a bigint, b bigint, height double")
    low = linkage.connected(ids, tree.join(tree.orderBy(F.desc("height"), F.desc("i"), F.desc("j")).limit(29).select("i", "j"), ["i", "j"], "left_anti").select("i", "j"))
    groups = linkage.cut(low.select(F.col("root").alias("id")).distinct(), undone, 5)
    placed = low.select("id", "root").join(groups.select(F.col("id").alias("root"), "cluster"), "root").select("id", "cluster")
    assert agreement.compare(placed, linkage.cut(ids, tree, 5, ("i", "j"))).first()["ARI"] == pytest.approx(1.0)


def test_analysis_beyond_the_representatives(spark):
    """Single linkage of more cases than representatives is exact, and so are the last stages of its schedule."""
    cases = crowd(spark, n=400, copies=3)
    df = materialize(cases.select("id", *[F.col("x")[j].alias(v) for j, v in enumerate("abc")]))
    config = ClusterConfig(("a", "b", "c"), "id", method="single", distance="manhattan", scaling="none", k_min=3, k_max=3, representatives=50)
    made = jobs.analyse(df, config, pair_indices=False)
    tree = materialize(linkage.spanning_tree(dist.pairs(cases, "manhattan"), cases.select("id")))
    expected = linkage.cut(cases.select("id"), tree, 3, ("i", "j"))
    assert agreement.compare(expected, made.memberships.select("id", "cluster")).first()["ARI"] == pytest.approx(1.0)
    assert made.tables["Agglomeration"].count() == 49
