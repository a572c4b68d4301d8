"""Whole analyses: imputations, validation of every method, hybrids, what is recorded when something fails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import ClusterConfig
from tessella.functions import matrices
from tessella.operators import agreement, groups, refit, resample, schedule
from tessella.plans import jobs
from tessella.session import materialize

VARIABLES = ("Stress", "Support", "Engagement")


def test_analysis_of_imputations_keeps_every_case(spark, example):
    """Gaps in numbers and in text: no case is dropped, every copy has its row of fits, the consensus is between classes."""
    side = F.when(F.col("n") % 6 != 0, F.when(F.col("Stress") > 2.5, "high").otherwise("low")).alias("Side")
    df = materialize(example.select("n", side, *[F.when(F.col("n") % (7 + i) != 0, F.col(v)).alias(v) for i, v in enumerate(VARIABLES)]))
    config = ClusterConfig((*VARIABLES, "Side"), "n", missing="multiple", method="complete", distance="gower", k_min=2, k_max=3, mi_m=3, mi_iter=2)
    made = jobs.analyse(df, config)
    assert made.memberships.where("k = 3").count() == 150 and made.config.missing == "multiple"
    fits = made.tables["MI_fit_summary"].collect()
    assert sorted((r["Imputation"], r["K"]) for r in fits) == [(i, k) for i in (1, 2, 3) for k in (2, 3)] and all(r["Status"] == "Completed" for r in fits)
    assert made.tables["MI_class_members"].count() == 150 and made.tables["MI_classes"].agg(F.sum("Cases")).first()[0] == 150
    audit = {r["ID"]: r for r in made.tables["Case_audit"].collect()}
    for n in range(1, 151):
        gaps = sum(n % (7 + i) == 0 for i in range(3)) + (n % 6 == 0)
        assert audit[n]["Original_missing"] == gaps == audit[n]["Imputed_cells"] and audit[n]["Status"] == "Retained"


def test_medoid_hybrid_starts_on_its_own_distance(spark):
    """Under Gower distance with gaps: start and swaps are those of brute force on that distance."""
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (20, 3))]) * [1, 50, 1]
    x[rng.random(x.shape) < 0.15] = np.nan
    x[np.isnan(x).all(1)] = 0
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    config = ClusterConfig(("a", "b", "c"), "id", missing="available", distance="gower", method="hybrid_pam", hybrid_start="average", k_min=3, k_max=3)
    made = jobs.analyse(df, config)
    d = matrices.square("gower", x, None, list(np.nanmax(x, 0) - np.nanmin(x, 0)))
    start = groups.start_labels(x, np.ones(40), d, "average", [3], -0.25)[3]
    first = [int(m[np.argmin(d[np.ix_(m, m)].sum(1))]) for g in np.unique(start) if len(m := np.flatnonzero(start == g))]
    label, _ = groups.swapped(d, np.ones(40), 3, first)
    got = {r["id"]: r["cluster"] for r in made.memberships.collect()}
    assert len({(label[i], got[i]) for i in range(40)}) == 3
    assert made.tables["Starting_partitions"].first()["Objective"] == pytest.approx(d[:, first].min(1).sum())
    row = made.comparison.first()
    widths = []
    for i in range(40):
        mean = {g: d[i, (label == g) & (np.arange(40) != i)].mean() for g in range(3) if ((label == g) & (np.arange(40) != i)).any()}
        own = mean.pop(label[i], None)
        widths.append(0.0 if own is None else (min(mean.values()) - own) / max(own, min(mean.values())))
    assert row["Silhouette"] == pytest.approx(np.mean(widths)) and row["Gamma"] is not None


@pytest.mark.parametrize("method, distance", [("average", "manhattan"), ("pam", "gower"), ("gmm", "euclidean"), ("diana", "mahalanobis"), ("fuzzy", "euclidean"), ("hybrid_kmeans", "euclidean")])
def test_validation_of_every_kind_of_method(example, method, distance):
    config = ClusterConfig(VARIABLES, "n", method=method, distance=distance, covariance="EEI", k_min=3, k_max=3, B=8, gap_B=4, subsample=method == "pam")
    made = jobs.analyse(example, config, validation=True)
    row = made.comparison.first()
    assert row["Status"] == "Completed", row
    assert 0 < row["Bootstrap_min_Jaccard"] <= 1 and row["Bootstrap_completed_B"] == 8 and row["Invariance"] is not None
    assert 1 / 9 - 1e-9 <= row["Simulation_p_Silhouette"] <= 1 and row["Simulation_valid_B"] <= 8
    assert {r["Topic"] for r in made.tables["Findings"].collect()} >= {"Smallest cluster", "Separation", "Stability", "Structure beyond chance", "Replication"}
    assert ("Gap" in made.tables) == (distance == "euclidean")
    if distance != "euclidean":
        assert any("Gap statistic" in r["Message"] for r in made.tables["Warnings"].collect())
    each = made.tables["Bootstrap_replicates"].collect()
    assert len(each) == 8 and {"ARI", "Rand", "Silhouette", "Error"} <= set(each[0].asDict())


@pytest.mark.parametrize("method", ["average", "gmm"])
def test_keyed_refits_equal_separate_ones(spark, example, method):
    x = F.array(*VARIABLES).alias("x")
    two = materialize(example.select(F.lit(1).alias("replicate"), F.col("n").alias("id"), x).unionByName(example.where("n % 3 <> 0").select(F.lit(2).alias("replicate"), F.col("n").alias("id"), x)))
    again = refit.of_method(ClusterConfig(VARIABLES, "n", method=method, distance="euclidean", covariance="VVI"))
    both = again(two, 3, ("replicate",))
    for key in (1, 2):
        own = again(two.where(F.col("replicate") == key).drop("replicate"), 3, ())
        got = both.where(F.col("replicate") == key).select("id", "cluster")
        assert agreement.compare(own.select("id", "cluster"), got).first()["ARI"] == pytest.approx(1.0)


def test_failed_replicates_are_counted(spark):
    """Two far cases and a crowd of copies: replicates that draw fewer than three distinct profiles fail."""
    rows = [(i, [0.0]) for i in range(12)] + [(12, [5.0]), (13, [9.0])]
    cases = materialize(spark.createDataFrame(rows, "id bigint, x array<double>"))
    partition = cases.select("id", F.when(F.col("id") < 12, 1).otherwise(F.col("id") - 10).cast("int").alias("cluster"))
    index = {r["replicate"]: set() for r in resample.drawn_replicates(cases, 12).select("replicate").distinct().collect()}
    for r in resample.drawn_replicates(cases, 12).collect():
        index[r["replicate"]].add(r["x"][0])
    failed = sum(len(v) < 3 for v in index.values())
    # Average linkage puts equal cases together first, so exactly the replicates with three profiles have three clusters.
    again = refit.of_method(ClusterConfig(("x",), "id", method="average"))
    fewer = sum(r["count"] for r in again(resample.drawn_replicates(cases, 12), 3, ("replicate",)).select("replicate").distinct().groupBy().count().collect())
    stable, agreed, each = resample.bootstrap_refits(cases, partition, 3, 12, lambda df, k, keys: again(df, k, keys).join(df.groupBy("replicate").agg(F.count_distinct("x").alias("d")).where("d >= 3").select("replicate"), "replicate", "left_semi"))
    assert 0 < failed < 12 and fewer == 12
    assert {(r["Failed_B"], r["Completed_B"], r["Requested_B"]) for r in stable.collect()} == {(failed, 12, 12)}
    rows = each.collect()
    assert sum(r["Error"] is not None for r in rows) == failed and all((r["ARI"] is None) == (r["Error"] is not None) for r in rows)
    assert {r["Valid_B"] for r in agreed.collect()} == {12 - failed}


def test_failures_have_their_reason(spark, example):
    few = example.where("n <= 6 or n > 140")
    config = ClusterConfig(VARIABLES, "n", method="fuzzy", k_min=2, k_max=12)
    made = jobs.analyse(few, config, pair_indices=False)
    status = {r["K"]: r["Status"] for r in made.comparison.collect()}
    assert status[2] == "Completed" and "fewer than 12 clusters" in status[12]
    with pytest.raises(ValueError, match="distinct cases"):
        jobs.analyse(spark.createDataFrame([(i, float(i % 2), 1.0 * (i % 2)) for i in range(9)], "id bigint, a double, b double"), ClusterConfig(("a", "b"), "id", k_min=3, k_max=3))


def test_many_cases_need_no_pairs(spark, monkeypatch):
    """More cases than pairs may be made of: the analysis says what it leaves out, and goes on."""
    monkeypatch.setattr(jobs, "EXACT_PAIRS", 10_000)
    monkeypatch.setattr(jobs, "MAX_PAIRS", 100_000)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2)) + 8 * rng.integers(0, 3, (600, 1))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")
    for method, distance in (("average", "manhattan"), ("kmeans", "euclidean")):
        made = jobs.analyse(df, ClusterConfig(("a", "b"), "id", method=method, distance=distance, k_min=2, k_max=3, nstart=3, representatives=80))
        assert {r["Status"] for r in made.comparison.collect()} == {"Completed"} and "Silhouette" not in made.comparison.columns
        assert sum("left out" in r["Message"] for r in made.tables["Warnings"].collect()) == 2
        got = {r["id"]: r["cluster"] for r in made.memberships.where("k = 3").collect()}
        assert len(got) == 600 and len({(round((x[i].mean()) / 8), c) for i, c in got.items()}) == 3


def walk(children, node):
    return [node] if node not in children else walk(children, children[node][0]) + walk(children, children[node][1])


@pytest.mark.parametrize("method", ["average", "single", "ward.D2", "centroid", "diana"])
def test_leaf_order_by_a_recursive_walk(spark, example, method):
    cases = materialize(example.where("n % 4 = 0").select(F.col("n").alias("id"), F.array(*VARIABLES).alias("x")))
    merges = materialize(groups.grouped_tree(cases, method))
    now, children = {}, {}
    for r in sorted(merges.collect(), key=lambda r: r["stage"]):
        pair = sorted((r["a"], r["b"]))
        children[("s", r["stage"])] = tuple(now.get(c, c) for c in pair)
        now[r["a"]] = ("s", r["stage"])
    staged = materialize(schedule.stages(merges))
    got = [r["id"] for r in schedule.leaf_order(staged).orderBy("position").collect()]
    assert got == walk(children, ("s", max(r["stage"] for r in merges.collect()))) and len(got) == 37


def test_leaf_order_of_a_tree_made_in_rounds(spark, example):
    from tessella.functions import distance as dist
    from tessella.operators import linkage

    cases = materialize(example.where("n % 5 = 0").select(F.col("n").alias("id"), F.array(*VARIABLES).alias("x")))
    staged = materialize(schedule.stages(materialize(linkage.mutual_merges(dist.pairs(cases, "manhattan", blocks=2), cases.select("id"), "complete", last=6))))
    leaves = schedule.leaf_order(staged).collect()
    assert sorted(r["position"] for r in leaves) == list(range(30)) and {r["id"] for r in leaves} == set(range(5, 151, 5))
    cut = linkage.cut(cases.select("id"), staged.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"), "height"), 4)
    runs = schedule.leaf_runs(materialize(schedule.leaf_order(staged).join(cut, "id").select("position", "id", "cluster"))).collect()
    assert len(runs) == 4  # every cluster is one run of leaves
