"""Clustering methods without an equivalent in SQL; their tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.config import ClusterConfig
from tessella.functions import distance as dist
from tessella.operators import describe, fuzzy, groups, linkage, medoids, mixture, prepare, refit, resample, schedule, spanning
from tessella.plans import fixtures as fx
from tessella.plans import jobs
from tessella.plans.evaluate_queries import standardised
from tessella.plans.registry import R, query
from tessella.session import materialize

C = fx.CUSTOMER


def _cases(spark, d):
    return materialize(standardised(spark, d).select("id", "x"))


@query("c8_single_linkage")
def _(spark, d):
    return linkage.block_spanning_tree(materialize(fx.vectors(spark, d).select("id", "x")), "euclidean")


@query("c8_block_tree", f"""WITH v AS ({fx.PARTS_SQL})
SELECT a.id, {R('min(sqrt((a.size - b.size) ** 2 + (a.price - b.price) ** 2))')} AS nearest, (SELECT count(*) - 1 FROM v) AS edges
FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id""")
def _(spark, d):
    """The spanning tree by blocks: the shortest edge at a case is the distance to its nearest neighbour."""
    tree = materialize(spanning.block_tree(fx.parts(spark, d).select("id", F.array("size", "price").alias("x"))))
    ends = tree.select(F.explode(F.array("i", "j")).alias("id"), "height")
    edges = F.broadcast(tree.agg(F.count(F.lit(1)).alias("edges")))
    return ends.groupBy("id").agg(F.min("height").alias("nearest")).crossJoin(edges)


def _by_blocks(code: str, method: str, name: str = "euclidean") -> None:
    @query(f"{code}_{method.replace('.', '_').lower()}_linkage")
    def _(spark, d):
        return linkage.block_merges(fx.vectors(spark, d), name, method)


_by_blocks("c9", "complete")
_by_blocks("c9", "average", "cosine")
_by_blocks("c9", "mcquitty")
_by_blocks("c10", "ward.D2")
_by_blocks("c10", "ward.D")
_by_blocks("c12", "flexible")


def _by_representatives(code: str, method: str) -> None:
    @query(f"{code}_{method}")
    def _(spark, d):
        return linkage.hierarchical(_cases(spark, d), method, [2, 3, 4], linkage.MAX_REPRESENTATIVES)


_by_representatives("c11", "centroid")
_by_representatives("c11", "median")
_by_representatives("c13", "diana")


@query("c14_cut_tree")
def _(spark, d):
    v = materialize(fx.vectors(spark, d))
    merges = materialize(linkage.block_merges(v, "euclidean", "complete"))
    return linkage.cut(v.select("id"), merges, 10)


@query("h1_h4_schedule_of_tree", digits=8)
def _(spark, d):
    v = materialize(fx.vectors(spark, d))
    return schedule.agglomeration(schedule.stages(linkage.mutual_merges(dist.pairs(v, "manhattan"), v.select("id"), "average")), "average")


@query("c15_pam")
def _(spark, d):
    return medoids.block_pam(fx.vectors(spark, d), "manhattan", 5)[0]


@query("c16_fuzzy", digits=5)
def _(spark, d):
    return fuzzy.block_fuzzy(fx.vectors(spark, d), "euclidean", 3)[0]


@query("c17_gaussian_mixture", digits=5)
def _(spark, d):
    return mixture.gmm(_cases(spark, d), 3, "VVI")[0].select("id", "cluster", F.array_max("prob").alias("posterior"))


@query("c18_c19_ward_relocation")
def _(spark, d):
    made = jobs.prepare.prepare(fx.customers(spark, d), ClusterConfig(tuple(C), "id", method="ward_relocate", representatives=linkage.MAX_REPRESENTATIVES))
    return jobs.fit(made, [3])


def _hybrid(method: str) -> None:
    @query(f"c19_{method}")
    def _(spark, d):
        config = ClusterConfig(tuple(C), "id", method=method, hybrid_start="average", representatives=linkage.MAX_REPRESENTATIVES)
        return jobs.fit(jobs.prepare.prepare(fx.customers(spark, d), config), [3])


_hybrid("hybrid_kmeans")
_hybrid("hybrid_relocate")
_hybrid("hybrid_pam")


@query("x9_scaling")
def _(spark, d):
    v = materialize(fx.vectors(spark, d))
    return describe.scaling_2d(materialize(dist.pairs(v, "cosine")), v.select("id"), rounds=8)


@query("x9_landmark_scaling", digits=5)
def _(spark, d):
    return describe.landmark_scaling(fx.vectors(spark, d).select("id", "x"), "cosine")


def _mixed(spark, d):
    """Prepared cases of two numbers, a 0/1 and an ordered variable under Gower distance."""
    variables = ("mean_total", "n_orders", "building", "last_priority")
    return prepare.prepare(fx.mixed(spark, d), ClusterConfig(variables, "id", distance="gower", method="average"))


def _on_mixed(name: str, method: str, beta: float = -0.25) -> None:
    @query(name)
    def _(spark, d):
        p = _mixed(spark, d)
        return groups.grouped_fit(p.cases.select("id", "x"), method, [2, 3, 4], "gower", linkage.MAX_REPRESENTATIVES, list(p.weights), p.ranges, beta=beta)


_on_mixed("c12_flexible_any_distance", "flexible", 0.5)
_on_mixed("c13_diana_any_distance", "diana")
_on_mixed("c15_pam_any_distance", "pam")


@query("c19_hybrid_pam_any_distance")
def _(spark, d):
    p = _mixed(spark, d)
    return groups.grouped_fit(p.cases.select("id", "x"), "hybrid_pam", [3], "gower", linkage.MAX_REPRESENTATIVES, list(p.weights), p.ranges, hybrid_start="complete", starts=True)


@query("h7_leaf_order_of_tree")
def _(spark, d):
    v = materialize(fx.vectors(spark, d))
    return schedule.leaf_order(schedule.stages(materialize(groups.grouped_tree(v.select("id", "x"), "average", "cosine"))))


def _refits(method: str, distance: str = "euclidean", **settings):
    """Prepared cases, a solution of three clusters and its refit."""

    def made(spark, d):
        p = jobs.prepare.prepare(fx.customers(spark, d), ClusterConfig(tuple(C), "id", method=method, distance=distance, **settings))
        p = jobs.replace(p, cases=materialize(p.cases))
        return p, materialize(jobs.fit(p, [3]).select("id", "cluster"))

    return made


@query("r3_subsampled_linkage")
def _(spark, d):
    p, made = _refits("complete", "manhattan", subsample=True, B=20)(spark, d)
    return jobs.validate(p, made, 3, pair_indices=False)["Bootstrap"]


@query("r3_bootstrap_mixture")
def _(spark, d):
    p, made = _refits("gmm", covariance="EEI")(spark, d)
    return resample.bootstrap_refits(p.cases.select("id", "x"), made, 3, 20, refit.of_method(p.config))[0]


@query("r10_null_ward", digits=5)
def _(spark, d):
    p, made = _refits("ward.D2")(spark, d)
    placed = materialize(p.cases.select("id", "x").join(made, "id"))
    observed = materialize(resample.solution_indices(placed, (), True))
    return resample.simulate_refits(jobs.null_data(p, 20), observed, 3, 20, refit.of_method(p.config))


@query("r12_gap_ward")
def _(spark, d):
    p, _ = _refits("ward.D2")(spark, d)
    return resample.gap(p.cases.select("id", "x"), 4, 20, refit=refit.of_method(p.config))


@query("r14_split_half_pam")
def _(spark, d):
    p, _ = _refits("pam", "manhattan")(spark, d)
    return resample.split_half(p.cases.select("id", "x"), 3, refit=refit.of_method(p.config))


@query("m6_stacked_fits", digits=5)
def _(spark, d):
    config = ClusterConfig(tuple(C), "id", missing="multiple", method="complete", distance="manhattan", k_min=2, k_max=3, mi_m=2, mi_iter=1)
    return jobs.analyse(fx.customers_with_gaps(spark, d), config, pair_indices=False).tables["MI_fit_summary"]


@query("m6_imputations_clustered")
def _(spark, d):
    return jobs.multiple_imputation(fx.customers_with_gaps(spark, d), ClusterConfig(tuple(C), "id", missing="multiple", method="kmeans", nstart=2, mi_m=2, mi_iter=1), 3)[0]


@query("full_analysis", digits=5)
def _(spark, d):
    config = ClusterConfig(tuple(C), "id", method="kmeans", k_max=3, nstart=3)
    return jobs.analyse(fx.customers(spark, d), config, describe_solution=False).comparison
