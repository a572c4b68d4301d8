"""Clustering methods against brute force and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import ClusterConfig
from tessella.functions import distance as dist
from tessella.operators import agreement, fuzzy, kmeans, linkage, medoids, mixture, prepare, resample, schedule
from tessella.plans import jobs
from tessella.session import materialize

VARIABLES = ["Stress", "Support", "Engagement"]


@pytest.fixture(scope="module")
def cases(example):
    z = prepare.assemble(prepare.scaled(example, VARIABLES, "z"), VARIABLES)
    return materialize(z.select(F.col("n").alias("id"), "x", F.col("g").alias("cluster")))


@pytest.fixture(scope="module")
def small(cases):
    return materialize(cases.where("id % 5 = 0").select("id", "x"))


@pytest.fixture(scope="module")
def small_pairs(small):
    return materialize(dist.pairs(small, "euclidean", blocks=3))


def ari(cases, partition):
    return agreement.compare(cases.select("id", "cluster"), partition.select("id", "cluster")).first()["ARI"]


def points(df):
    rows = df.orderBy("id").collect()
    return [r["id"] for r in rows], np.array([r["x"] for r in rows])


def naive_heights(x, method, beta=-0.25):
    """Merge heights from the definition of Lance-Williams, one merge at a time."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return sorted(h for _, _, h in linkage.lance_williams(d**2 if method in linkage.SQUARED else d, np.ones(len(x)), method, beta))


def test_pairs_are_all_pairs(small, small_pairs):
    ids, x = points(small)
    got = {(r["i"], r["j"]): r["d"] for r in small_pairs.collect()}
    assert len(got) == len(ids) * (len(ids) - 1) // 2
    for a in range(len(ids)):
        for b in range(a):
            assert got[ids[b], ids[a]] == pytest.approx(np.linalg.norm(x[a] - x[b]))


def test_average_linkage_by_definition():
    """The rule agrees with the mean of all distances between two groups."""
    x = np.random.default_rng(1).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = {i: [i] for i in range(12)}
    for a, b, h in linkage.lance_williams(d, np.ones(12), "average"):
        assert h == pytest.approx(np.mean(d[np.ix_(groups[a], groups[b])]))
        groups[a] += groups.pop(b)


def test_ward_heights_are_growth_of_within_ss():
    x = np.random.default_rng(2).normal(size=(15, 3))
    groups = {i: [i] for i in range(15)}
    ss = lambda m: ((x[m] - x[m].mean(0)) ** 2).sum()
    for a, b, h in linkage.lance_williams(((x[:, None] - x[None]) ** 2).sum(-1), np.ones(15), "ward.D2"):
        assert h * h / 2 == pytest.approx(ss(groups[a] + groups[b]) - ss(groups[a]) - ss(groups[b]))
        groups[a] += groups.pop(b)


@pytest.mark.parametrize("method", ["complete", "average", "ward.D2"])
def test_rounds_give_the_heights_of_single_steps(small, small_pairs, method):
    _, x = points(small)
    made = linkage.mutual_merges(small_pairs, small.select("id"), method, last=1)
    assert sorted(r["height"] for r in made.collect()) == pytest.approx(naive_heights(x, method))


def test_last_merges_agree_with_rounds(small, small_pairs):
    _, x = points(small)
    made = linkage.mutual_merges(small_pairs, small.select("id"), "mcquitty", last=12)
    assert sorted(r["height"] for r in made.collect()) == pytest.approx(naive_heights(x, "mcquitty"))


def test_spanning_tree_and_cut(small, small_pairs):
    _, x = points(small)
    tree = linkage.spanning_tree(small_pairs, small.select("id"))
    assert sorted(r["height"] for r in tree.collect()) == pytest.approx(naive_heights(x, "single"))
    cut = linkage.cut(small.select("id"), tree, 3, ("i", "j"))
    assert cut.count() == small.count() and {r[0] for r in cut.select("cluster").distinct().collect()} == {1, 2, 3}


def test_connected_components_of_a_chain(spark):
    ids = spark.range(1, 40)
    edges = ids.where("id < 20 and id <> 9").select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    roots = {r["id"]: r["root"] for r in linkage.connected(ids, edges).collect()}
    assert roots == {i: 1 if i <= 9 else 10 if i <= 20 else i for i in range(1, 40)}


@pytest.mark.parametrize("method", ["ward.D2", "complete", "average", "diana"])
def test_hierarchies_recover_the_groups(cases, method):
    made = linkage.hierarchical(cases.select("id", "x"), method, [3], 150)
    assert ari(cases, made) > (0.9 if method == "ward.D2" else 0.4)  # two of the groups touch


def test_kmeans_recovers_the_groups_whatever_the_partitioning(cases):
    a = kmeans.kmeans(cases.select("id", "x"), 3, 5, 8)
    b = kmeans.kmeans(cases.select("id", "x").repartition(7), 3, 5, 8)
    assert ari(cases, a) > 0.85
    assert {(r["id"], r["cluster"]) for r in a.collect()} == {(r["id"], r["cluster"]) for r in b.collect()}


def test_keyed_kmeans_equals_separate_runs(cases):
    two = cases.select("id", "x").withColumn("replicate", F.explode(F.array(F.lit(1), F.lit(2))))
    two = materialize(two.where("replicate = 1 or id > 40"))
    both = kmeans.kmeans(two, 3, 4, 6, keys=("replicate",))
    assert ari(cases, both.where("replicate = 1")) > 0.85
    assert both.where("replicate = 2").count() == 110


def test_relocation_lowers_the_sum_of_squares(cases):
    start = cases.select("id", "x", (F.col("id") % 3 + 1).cast("int").alias("cluster"))
    made, trace = kmeans.relocate(start, max_iter=10)
    ss = [t["Within_SS"] for t in trace]
    assert all(b <= a + 1e-9 for a, b in zip(ss, ss[1:])) and made.select("cluster").distinct().count() == 3
    assert ari(cases, made) > 0.9


def test_pam_total_is_no_worse_than_any_single_swap(small, small_pairs):
    ids, x = points(small)
    _, chosen, total = medoids.pam(small_pairs, small.select("id"), 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    at = [ids.index(m) for m in chosen]
    assert total == pytest.approx(d[:, at].min(1).sum())
    for out in range(3):
        for new in range(len(ids)):
            other = [new if i == out else m for i, m in enumerate(at)]
            assert d[:, other].min(1).sum() >= total - 1e-9


def test_fuzzy_objective_falls_and_groups_are_found(cases):
    some = materialize(cases.where("id % 3 = 0"))
    u, trace = fuzzy.fuzzy(dist.pairs(some, "euclidean", blocks=3), some.select("id"), 3, rounds=12)
    assert trace[-1] <= trace[0]
    assert u.groupBy("id").agg(F.sum("u").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    assert ari(some, fuzzy.hard(u, 3)) > 0.8


def test_mixture_likelihood_and_parameters(cases):
    made, mix = mixture.gmm(cases.select("id", "x"), 3, "VVV", rounds=10)
    assert ari(cases, made) > 0.9 and mix.parameters == 2 + 9 + 18
    first = mixture.em(cases, 3, "EII", rounds=2)
    later = mixture.em(cases, 3, "EII", rounds=8)
    assert later.log_likelihood >= first.log_likelihood - 1e-6


@pytest.mark.parametrize("method", ["kmeans", "ward_relocate"])
def test_analysis_runs_through(example, method):
    result = jobs.analyse(example, ClusterConfig(tuple(VARIABLES), "ID", method=method, k_min=2, k_max=4, nstart=4, max_iter=8, representatives=150) if method == "kmeans" else ClusterConfig(tuple(VARIABLES), "n", method=method, k_min=3, k_max=3, max_iter=6, representatives=150), pair_indices=False)
    assert result.comparison.where("Status = 'Completed'").count() >= 1
    profile = result.tables["Profiles"].where("Cluster = 'All'").first()
    assert profile["N"] == 150
    if method == "kmeans":
        assert result.suggested in (2, 3)  # one group stands apart from two that touch


def test_lloyd_stops_when_no_centre_moves(cases):
    start = materialize(kmeans.random_seeds(cases, 3, 1, 1).select("cluster", "center"))
    few = kmeans.lloyd(cases.select("id", "x"), start, 60)
    more = kmeans.lloyd(cases.select("id", "x"), few, 1)
    a, b = ({r["cluster"]: r["center"] for r in df.collect()} for df in (few, more))
    assert all(a[c] == pytest.approx(b[c], abs=1e-8) for c in a)


def test_pam_starts_from_given_medoids(small, small_pairs):
    """From the medoids of the best solution nothing is swapped; without swaps the start is kept."""
    _, best, total = medoids.pam(small_pairs, small.select("id"), 3)
    assert medoids.pam(small_pairs, small.select("id"), 3, start=best)[1:] == (best, total)
    ids, _ = points(small)
    assert medoids.pam(small_pairs, small.select("id"), 3, max_swaps=0, start=ids[:3])[1] == sorted(ids[:3])


def test_pairs_without_a_common_variable_are_far_apart(spark):
    rows = [(1, 1.0, None), (2, None, 3.0), (3, 5.0, 4.0), (4, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    p = jobs.prepare.prepare(df, ClusterConfig(("a", "b"), "id", missing="available", distance="gower", method="average"))
    got = {(r["i"], r["j"]): r["d"] for r in jobs.pairs_of(p).collect()}
    assert got[1, 2] == 1.0 and len(got) == 6 and got[1, 3] == pytest.approx(1.0) and got[3, 4] == pytest.approx((3 / 4 + 5 / 6) / 2)


def test_hierarchy_refined_by_medoids(example):
    made = jobs.analyse(example, ClusterConfig(tuple(VARIABLES), "n", method="hybrid_pam", k_min=3, k_max=3, representatives=150), pair_indices=False)
    assert made.comparison.where("Status = 'Completed' and K = 3").count() == 1


@pytest.mark.parametrize(("method", "far"), [("complete", np.max), ("average", np.mean)])
def test_linkages_by_the_distances_between_groups(small, small_pairs, method, far):
    """Heights from the members of the groups alone, without any update rule."""
    _, x = points(small)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups, heights = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        h, a, b = min((far(d[np.ix_(p, q)]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        heights.append(h)
        groups[a] += groups.pop(b)
    made = linkage.mutual_merges(small_pairs, small.select("id"), method, last=4)
    assert sorted(r["height"] for r in made.collect()) == pytest.approx(sorted(heights))


def test_centroid_matching_by_all_permutations():
    import pandas as pd

    rng = np.random.default_rng(5)
    gaps = pd.DataFrame([(a, b, rng.random()) for a in range(1, 5) for b in range(1, 5)], columns=["Cluster_A", "Cluster_B", "ASED"])
    table = gaps.pivot(index="Cluster_A", columns="Cluster_B", values="ASED").to_numpy()
    from itertools import permutations

    best = min(sum(table[i, p[i]] for i in range(4)) for p in permutations(range(4)))
    assert agreement.match_centroids(gaps, globally=True)["ASED"].sum() == pytest.approx(best)
    greedy = agreement.match_centroids(gaps, globally=False)
    first = greedy.iloc[0]
    assert first["ASED"] == table.min() and sorted(greedy["Cluster_A"]) == [1, 2, 3, 4] == sorted(greedy["Cluster_B"])
    assert list(greedy["ASED"]) == sorted(greedy["ASED"])


def naive_tree(ids, x, method):
    """(first case a, first case b, height, sizes' stages) of each merge, from all distances between two groups."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    far = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    groups, formed, out = {i: [i] for i in range(len(ids))}, {}, []
    while len(groups) > 1:
        h, a, b = min((far(d[np.ix_(groups[a], groups[b])]), a, b) for a in groups for b in groups if a < b)
        out.append((len(out) + 1, ids[a], ids[b], h, formed.get(a, 0), formed.get(b, 0)))
        groups[a] += groups.pop(b)
        formed[a] = len(out)
    return out


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_schedule_of_a_tree_by_single_merges(small, small_pairs, method):
    ids, x = points(small)
    made = schedule.agglomeration(schedule.stages(linkage.mutual_merges(small_pairs, small, method, last=8)), method)
    got = [tuple(r) for r in made.select("Stage", "Cluster_1", "Cluster_2", "Coefficient", "First_stage_cluster_1", "First_stage_cluster_2", "Next_stage", "Clusters_after_stage").orderBy("Stage").collect()]
    expected = naive_tree(ids, x, method)
    after = {f: stage for stage, *_, fa, fb in expected for f in (fa, fb) if f}
    assert [(s, a, b, pytest.approx(h), fa, fb, after.get(s, 0), len(ids) - s) for s, a, b, h, fa, fb in expected] == got


def test_equal_heights_form_groups_before_they_merge(spark):
    x = spark.createDataFrame([(i, [float(i)]) for i in range(1, 9)], "id bigint, x array<double>")
    made = schedule.stages(linkage.mutual_merges(dist.pairs(x, "euclidean", blocks=2), x, "single", last=2)).collect()
    assert len(made) == 7 and all(r["a"] < r["stage"] and r["b"] < r["stage"] for r in made)
    assert sorted(s for r in made for s in (r["a"], r["b"]) if s) == list(range(1, 7))


@pytest.mark.parametrize("method, distance", [("ward.D2", "euclidean"), ("average", "manhattan")])
def test_analysis_has_the_schedule_of_its_tree(example, method, distance):
    config = ClusterConfig(tuple(VARIABLES), "n", method=method, distance=distance, k_min=3, k_max=3, representatives=150)
    made = jobs.analyse(example, config, pair_indices=False).tables["Agglomeration"]
    rows = made.orderBy("Stage").collect()
    assert len(rows) == 149 and rows[-1]["Cluster_1"] == 1 and rows[-1]["Next_stage"] == 0
    top = schedule.largest_increase(made, [2, 3, 4, 5], 2).collect()
    assert top[0]["K"] in (2, 3) and top[0]["Relative_increase"] >= top[1]["Relative_increase"]
    if method == "ward.D2":  # the last coefficient is the total sum of squares of three z-scaled variables
        assert rows[-1]["Coefficient"] == pytest.approx(3 * 149)


def test_mixture_criteria_decide_the_number_of_components(example):
    made = jobs.analyse(example, ClusterConfig(tuple(VARIABLES), "n", method="gmm", covariance="EEI", k_min=1, k_max=4), pair_indices=False)
    rows = {r["K"]: r for r in made.comparison.collect()}
    assert made.suggested == min(rows, key=lambda k: rows[k]["BIC"]) == 3
    for k, r in rows.items():
        assert r["BIC"] == pytest.approx(-2 * r["Log_likelihood"] + r["Parameters"] * np.log(150))
        assert r["AIC"] == pytest.approx(-2 * r["Log_likelihood"] + 2 * r["Parameters"])
    assert rows[1]["Relative_entropy"] is None and rows[3]["Relative_entropy"] > 0.9


def test_analysis_with_validation(example):
    config = ClusterConfig(tuple(VARIABLES), "n", method="kmeans", k_min=3, k_max=4, nstart=3, B=9, gap_B=5)
    made = jobs.analyse(example, config, pair_indices=False, validation=True)
    rows = {r["K"]: r for r in made.comparison.collect()}
    assert rows[3]["Bootstrap_min_Jaccard"] > 0.85 and rows[3]["Bootstrap_ARI"] > 0.9 and rows[3]["Invariance"] > 0.8
    assert rows[3]["Simulation_p_CH"] == pytest.approx(0.1) and rows[3]["Bootstrap_valid_B"] == 9
    assert rows[4]["Bootstrap_min_Jaccard"] < rows[3]["Bootstrap_min_Jaccard"]
    assert made.tables["Bootstrap"].count() == 7 and made.tables["Gap"].count() == 4 and made.tables["Replication"].count() == 2
    assert "Gap statistic" in [r["Index"] for r in made.tables["Fit_indices"].collect()] and made.suggested == 3
    assert rows[3]["Simulation_p_Silhouette"] is None  # pair indices were left out


def test_indexed_counts_wide_rows_once(spark):
    wide = spark.range(0, 400_000, 1, 8).select(F.md5(F.col("id").cast("string")).alias("key"), F.repeat(F.lit("x"), 60).alias("pad"), F.col("id").alias("n"))
    made = materialize(resample.indexed(wide, "key"))
    assert made.agg(F.count_distinct("index"), F.min("index"), F.max("index")).first()[:] == (400_000, 0, 399_999)
    before = made.alias("a").join(made.alias("b"), F.col("a.index") + 1 == F.col("b.index"))
    assert before.where("a.key >= b.key").isEmpty()


def _in_two_keys(spark, example):
    x = F.array(*VARIABLES).alias("x")
    whole = example.select(F.lit(1).alias("replicate"), F.col("n").alias("id"), F.col("g").alias("cluster"), x)
    return whole.unionByName(whole.where("id % 3 <> 0").withColumn("replicate", F.lit(2)).withColumn("cluster", F.col("id").cast("int") % 2)).cache()


def test_indices_of_each_key_are_those_of_its_own_cases(spark, example):
    cases = _in_two_keys(spark, example)
    keyed = {r["replicate"]: r.asDict() for r in resample.solution_indices(cases, ("replicate",), True, True).collect()}
    for key in (1, 2):
        own = resample.solution_indices(cases.where(F.col("replicate") == key).drop("replicate"), (), True, True).first().asDict()
        assert set(own) >= {"EESS", "CH", "DB", "Silhouette", "Dunn", "Point_biserial", "WB", "C_index", "Gamma", "G_plus"}
        assert all(keyed[key][name] == pytest.approx(value) for name, value in own.items())


def test_silhouettes_of_replicates_by_definition(spark, example):
    cases = _in_two_keys(spark, example)
    made = {r["replicate"]: r["Silhouette"] for r in resample.replicate_silhouettes(cases).collect()}
    for key in (1, 2):
        rows = cases.where(F.col("replicate") == key).collect()
        x, label = np.array([r["x"] for r in rows]), np.array([r["cluster"] for r in rows])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        widths = []
        for i in range(len(x)):
            mean = {c: d[i, (label == c) & (np.arange(len(x)) != i)].mean() for c in set(label.tolist())}
            a, b = mean.pop(int(label[i])), min(mean.values())
            widths.append((b - a) / max(a, b))
        assert made[key] == pytest.approx(np.mean(widths))


def test_passes_and_joins_give_the_same_centres(spark, example, monkeypatch):
    """Groups with different numbers of starts, a start with fewer clusters, a cluster that gets no case, equal centres."""
    cases = _in_two_keys(spark, example)
    far, near = [99.0, 99.0, 99.0], [1.0, 4.0, 4.0]
    rows = [(1, 1, 1, near), (1, 1, 2, [4.0, 1.0, 2.0]), (1, 1, 3, far), (1, 2, 1, near), (1, 2, 2, near), (2, 1, 1, [0.0, 0.0, 0.0]), (2, 1, 2, [3.0, 4.0, 3.0])]
    seeds = spark.createDataFrame(rows, "replicate int, start int, cluster int, center array<double>")
    of = lambda: sorted((r["replicate"], r["start"], r["cluster"], *r["center"]) for r in kmeans.lloyd(cases, seeds, 40, ("replicate",), True).collect())
    passes = of()
    monkeypatch.setattr(kmeans, "BROADCAST_NUMBERS", -1)
    joins = of()
    assert len(passes) == len(rows) and np.allclose(passes, joins)
    assert any(row[3:] == (99.0, 99.0, 99.0) for row in passes)


def test_plus_plus_seeds_are_spread(spark, example):
    """Seeds are cases of their own key, differ while cases do, and are drawn far apart; the deal does not matter."""
    cases = materialize(_in_two_keys(spark, example).select("replicate", "id", "x"))
    made = kmeans.plus_plus_seeds(cases, 3, 30, 5, ("replicate",))
    again = kmeans.plus_plus_seeds(cases.repartition(5), 3, 30, 5, ("replicate",))
    rows = {(r["replicate"], r["start"], r["cluster"]): tuple(r["center"]) for r in made.collect()}
    assert len(rows) == 180 and rows == {(r["replicate"], r["start"], r["cluster"]): tuple(r["center"]) for r in again.collect()}
    own = {k: {tuple(r["x"]) for r in cases.where(F.col("replicate") == k).collect()} for k in (1, 2)}
    assert all(x in own[k] for (k, _, _), x in rows.items())
    assert all(len({rows[k, s, c] for c in (1, 2, 3)}) == 3 for k in (1, 2) for s in range(1, 31))
    x = np.array(sorted(own[1]))
    reach = lambda c: ((x[:, None] - np.array(c)[None]) ** 2).sum(2).min(1).mean()
    spread = np.mean([reach([rows[1, s, c] for c in (1, 2, 3)]) for s in range(1, 31)])
    rng = np.random.default_rng(0)
    assert spread < np.mean([reach(x[rng.choice(len(x), 3, replace=False)]) for _ in range(300)])
    few = spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)], "id bigint, x array<double>")
    seeds = kmeans.plus_plus_seeds(few, 3, 4, 1).collect()
    assert len(seeds) == 12 and all({r["center"][0] for r in seeds if r["start"] == s} == {0.0, 1.0} for s in range(1, 5))
