"""Resampling: bootstrap and subsamples, null data, gap statistic, split-half replication.

A replicate is a key column, so all replicates are drawn, clustered and summarised in the same jobs.
Draws come from hashes of (seed, stream, replicate, id or slot): they do not depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import key_hash, key_uniform
from tessella.operators import agreement, evaluate, kmeans
from tessella.operators.order import order_statistics, ranked, smallest
from tessella.operators.refit import Refit, of_kmeans
from tessella.session import indexed, materialize

LOWER_IS_BETTER = ("DB", "C_index", "G_plus", "WB", "Negative_silhouette_pct")


def _slots(case_index: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, slot, index): the draws, as rows of a range that tasks make by themselves."""
    every = case_index.sparkSession.range(n * replicates)
    slots = every.select(F.expr(f"id div {max(n, 1)} + 1").alias("replicate"), (F.col("id") % max(n, 1)).cast("int" if n < 2**31 else "bigint").alias("slot"))
    return slots.withColumn("index", F.pmod(key_hash(str(seed), "boot", F.col("replicate"), F.col("slot")), F.lit(n)))


def bootstrap(case_index: DataFrame, n: int, replicates: int, seed: int = 2026) -> DataFrame:
    """(replicate, slot, id): n draws with replacement per replicate from ``case_index(index, id)``."""
    return _slots(case_index, n, replicates, seed).join(case_index.select("index", "id"), "index").select("replicate", "slot", "id")


def bootstrap_counts(case_index: DataFrame, n: int, replicates: int, seed: int = 2026) -> DataFrame:
    """(replicate, index, n): how often each case is drawn by ``bootstrap``, added up where the draws are made."""
    return _slots(case_index, n, replicates, seed).groupBy("replicate", "index").agg(F.count(F.lit(1)).alias("n"))


def _copies(refits: DataFrame) -> Column:
    """The number of drawn cases behind rows of refits: of column n, if they have one."""
    return F.sum("n") if "n" in refits.columns else F.count(F.lit(1))


def subsample_size(n: int, k_max: int, fraction: float) -> int:
    return min(n, max(min(k_max, n - 1) + 1, math.ceil(n * fraction)))


def subsample(cases: DataFrame, size: int, replicates: int, seed: int = 2026) -> DataFrame:
    """(replicate, id): ``size`` cases without replacement per replicate, those of smallest hash; no task sorts a replicate."""
    drawn = cases.select("id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("_u", key_hash(str(seed), "sub", F.col("replicate"), F.col("id")))
    return smallest(drawn, ("replicate",), "_u", size, cases.count()).select("replicate", "id")


def cluster_jaccard(original: DataFrame, refits: DataFrame) -> DataFrame:
    """(replicate, cluster, Jaccard): best overlap of each cluster of ``original(id, cluster)`` with one of
    ``refits(replicate, id, cluster[, n])``, drawn copies (rows, or n of a row) counted; clusters that were not drawn have no row."""
    met = refits.withColumnRenamed("cluster", "new").join(original.select("id", F.col("cluster").alias("old")), "id")
    cells = met.groupBy("replicate", "old", "new").agg(_copies(refits).alias("n"))
    olds = cells.groupBy("replicate", "old").agg(F.sum("n").alias("no"))
    news = cells.groupBy("replicate", "new").agg(F.sum("n").alias("nn"))
    both = cells.join(olds, ["replicate", "old"]).join(news, ["replicate", "new"])
    overlap = F.col("n") / (F.col("no") + F.col("nn") - F.col("n"))
    return both.groupBy("replicate", F.col("old").alias("cluster")).agg(F.max(overlap).alias("Jaccard"))


def replicate_agreement(original: DataFrame, refits: DataFrame) -> DataFrame:
    """(replicate, ARI, Rand) on distinct cases; a case drawn several times takes its most frequent new
    label, the lowest on ties."""
    votes = refits.groupBy("replicate", "id", "cluster").agg(_copies(refits).alias("v"))
    label = votes.groupBy("replicate", "id").agg(F.min_by("cluster", F.struct(-F.col("v"), F.col("cluster"))).alias("y"))
    table = label.join(original.select("id", F.col("cluster").alias("x")), "id").groupBy("replicate", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return agreement.agreement(table, ("replicate",)).select("replicate", "ARI", "Rand")


def stability(jaccards: DataFrame, clusters: DataFrame, requested: int, failed: int = 0) -> DataFrame:
    """Per cluster of ``clusters(cluster)``: Mean_Jaccard, P025, P975, Dissolution (share <= .5), Recovery
    (share >= .75), Valid_B, Failed_B, Completed_B, Requested_B. A replicate in which a cluster was not drawn, or whose refit
    failed, has no value; all requested ones are run."""
    j = F.col("Jaccard")
    found = jaccards.groupBy("cluster").agg(
        F.avg(j).alias("Mean_Jaccard"), F.percentile(j, 0.025).alias("P025"), F.percentile(j, 0.975).alias("P975"),
        F.avg((j <= 0.5).cast("double")).alias("Dissolution"), F.avg((j >= 0.75).cast("double")).alias("Recovery"), F.count(j).alias("Valid_B"),
    )
    return clusters.select("cluster").distinct().join(found, "cluster", "left").select(
        F.col("cluster").alias("Cluster"), "Mean_Jaccard", "P025", "P975", "Dissolution", "Recovery", F.coalesce("Valid_B", F.lit(0)).alias("Valid_B"),
        F.lit(failed).cast("bigint").alias("Failed_B"), F.lit(requested).cast("bigint").alias("Completed_B"), F.lit(requested).cast("bigint").alias("Requested_B"),
    )


def agreement_summary(per_replicate: DataFrame, requested: int) -> DataFrame:
    long = per_replicate.select(F.explode(F.array(*[F.struct(F.lit(i).alias("Index"), F.col(i).alias("v")) for i in ("ARI", "Rand")])).alias("r")).select("r.*")
    return long.groupBy("Index").agg(F.avg("v").alias("Mean"), F.percentile("v", 0.025).alias("P025"), F.percentile("v", 0.975).alias("P975"), F.count("v").alias("Valid_B"), F.lit(requested).cast("bigint").alias("Requested_B"))


def permuted(case_index: DataFrame, variables: list[str], replicates: int, seed: int = 2026) -> DataFrame:
    """(replicate, index, variables): each column of ``case_index(index, variables)`` shuffled on its own, by
    order of hash. Ranges of all replicates and columns are sorted, not one task per column."""
    cells = case_index.select("index", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).alias("value")) for v in variables])).alias("c")).select("replicate", "index", "c.*")
    shuffled = [key_hash(str(seed), "perm", F.col("replicate"), F.col("v"), F.col("index")), "index"]
    moved = ranked(cells, ("replicate", "v"), shuffled, "_rank").withColumn("index", (F.col("_rank") - 1).cast("bigint"))
    return moved.groupBy("replicate", "index").pivot("v", variables).agg(F.first("value"))


def gaussian(cases: DataFrame, variables: list[str], replicates: int, seed: int = 2026) -> DataFrame:
    """(replicate, id, variables): one Gaussian with the mean and covariance of the cases."""
    p = len(variables)
    row = cases.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(variables)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(variables) for j, b in enumerate(variables) if i <= j]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    values, vectors = np.linalg.eigh(cov)
    root = vectors * np.sqrt(np.maximum(values, 0))
    base = cases.select("id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))

    def normal(j: int):
        u1 = F.greatest(key_uniform(str(seed), "g1", F.col("replicate"), F.col("id"), str(j)), F.lit(1e-18))
        return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * key_uniform(str(seed), "g2", F.col("replicate"), F.col("id"), str(j)))

    drawn = base.select("replicate", "id", *[normal(j).alias(f"_z{j}") for j in range(p)])
    return drawn.select("replicate", "id", *[(F.lit(float(row[f"m{i}"])) + sum((F.col(f"_z{j}") * float(root[i, j]) for j in range(p)), F.lit(0.0))).alias(v) for i, v in enumerate(variables)])


def empirical_p(observed: DataFrame, null: DataFrame, requested: int) -> DataFrame:
    """Index, Observed, Null_mean, Null_SD, Empirical_p = (1 + number as extreme) / (valid + 1), MC_SE, Valid_B,
    Failed_B, Completed_B, Requested_B, from ``observed(Index, value)`` and ``null(replicate, Index, value)``."""
    met = null.join(F.broadcast(observed.select("Index", F.col("value").alias("Observed"))), "Index")
    low = F.col("Index").isin(*LOWER_IS_BETTER)
    extreme = F.when(low, F.col("value") <= F.col("Observed")).otherwise(F.col("value") >= F.col("Observed"))
    row = met.where("value is not null").groupBy("Index", "Observed").agg(
        F.avg("value").alias("Null_mean"), F.stddev_samp("value").alias("Null_SD"), ((1 + F.count_if(extreme)) / (F.count(F.lit(1)) + 1)).alias("Empirical_p"), F.count(F.lit(1)).alias("Valid_B"), F.count_distinct("replicate").alias("Completed_B")
    )
    p, n = F.col("Empirical_p"), F.col("Valid_B")
    return row.select("Index", "Observed", "Null_mean", "Null_SD", "Empirical_p", F.sqrt(p * (1 - p) / (n + 1)).alias("MC_SE"), "Valid_B", (F.lit(requested) - F.col("Completed_B")).alias("Failed_B"), "Completed_B", F.lit(requested).cast("bigint").alias("Requested_B"))


def gap_table(observed: DataFrame, reference: DataFrame) -> DataFrame:
    """K, logW, E_logW, gap, SE from ``observed(K, ss)`` and ``reference(replicate, K, ss)``: W is half the
    within-cluster sum of squares, SE = sd * sqrt(1 + 1 / B) with the population SD."""
    sims = reference.groupBy("K").agg(F.avg(F.log(F.col("ss") / 2)).alias("E_logW"), (F.stddev_pop(F.log(F.col("ss") / 2)) * F.sqrt(1 + 1 / F.count(F.lit(1)))).alias("SE"))
    return observed.select("K", F.log(F.col("ss") / 2).alias("logW")).join(sims, "K").select("K", "logW", "E_logW", (F.col("E_logW") - F.col("logW")).alias("gap"), "SE")


def gap_candidate(table: DataFrame) -> DataFrame:
    """K: the smallest k with gap_k >= gap_(k+1) - SE_(k+1), else the largest. The table has a row per k."""
    ahead = Window.orderBy("K")
    met = table.withColumn("_ok", F.col("gap") >= F.lead("gap").over(ahead) - F.lead("SE").over(ahead))
    return met.agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("K"))), F.max("K")).alias("K"))


def uniform_box(cases: DataFrame, replicates: int, seed: int = 2026) -> DataFrame:
    """(replicate, id, x): uniform in the box of the principal components of ``cases(id, x)``."""
    size = kmeans.dimensions(cases)
    at = lambda j: F.col("x")[j]
    row = cases.agg(*[F.avg(at(j)).alias(f"m{j}") for j in range(size)], *[F.covar_samp(at(i), at(j)).alias(f"c{i}_{j}") for i in range(size) for j in range(i, size)]).first()
    mean = np.array([row[f"m{j}"] for j in range(size)])
    _, vectors = np.linalg.eigh(np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)], float))
    score = lambda j: sum(((at(i) - float(mean[i])) * float(vectors[i, j]) for i in range(size)), F.lit(0.0))
    box = cases.agg(*[F.min(score(j)).alias(f"lo{j}") for j in range(size)], *[F.max(score(j)).alias(f"hi{j}") for j in range(size)]).first()
    base = cases.select("id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = base.select("replicate", "id", *[(float(box[f"lo{j}"]) + float(box[f"hi{j}"] - box[f"lo{j}"]) * key_uniform(str(seed), "gap", F.col("replicate"), F.col("id"), str(j))).alias(f"_u{j}") for j in range(size)])
    return drawn.select("replicate", "id", F.array(*[F.lit(float(mean[i])) + sum((F.col(f"_u{j}") * float(vectors[i, j]) for j in range(size)), F.lit(0.0)) for i in range(size)]).alias("x"))


def gap(cases: DataFrame, k_max: int, replicates: int, seed: int = 2026, nstart: int = 3, rounds: int = 30, refit: Refit | None = None) -> DataFrame:
    """Gap statistic for k = 1..k_max of k-means, or of the method of ``refit``, all reference sets clustered together.
    A reference set without a solution of k clusters does not count for that k."""
    refit = refit or of_kmeans(nstart, rounds, seed)
    reference = materialize(uniform_box(cases, replicates, seed))
    size = kmeans.dimensions(cases)
    one = lambda df: df.withColumn("cluster", F.lit(1))
    observed, simulated = None, None
    for k in range(1, k_max + 1):
        own = kmeans.partition_ss(one(cases) if k == 1 else refit(cases, k, ()), size).select(F.lit(k).alias("K"), "ss")
        sim = kmeans.partition_ss(one(reference) if k == 1 else refit(reference, k, ("replicate",)), size, ("replicate",)).select("replicate", F.lit(k).alias("K"), "ss")
        observed, simulated = (own, sim) if observed is None else (observed.unionByName(own), simulated.unionByName(sim))
    return gap_table(observed, simulated)


def halves(cases: DataFrame, n: int, seed: int = 2026) -> DataFrame:
    """(id, half): floor(n / 2) cases of smallest hash in A, the rest in B. The cut is an exact order statistic, of equal hashes
    at the cut the smaller ids are in A."""
    keyed = cases.select("id", key_hash(str(seed), "half", F.col("id")).alias("_h"))
    last = {"_cut": lambda _: F.lit(n // 2 - 1)}
    cut = order_statistics(keyed, (), max(0.0, (n // 2 - 1) / max(n - 1, 1)), last, "_h").select("_cut", F.col("before__cut").alias("_less"))
    met = keyed.crossJoin(F.broadcast(materialize(cut)))
    at = met.where(F.col("_h") == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("id")))
    half = lambda first: F.when(first, "A").otherwise("B").alias("half")
    return met.where(F.col("_h") != F.col("_cut")).select("id", half(F.col("_h") < F.col("_cut"))).unionByName(at.select("id", half(F.col("_less") + F.col("_r") <= n // 2)))


def split_half(cases: DataFrame, k: int, seed: int = 2026, nstart: int = 10, rounds: int = 30, refit: Refit | None = None) -> DataFrame:
    """K, Kappa_half_B, Kappa_half_A, Invariance: both halves are clustered (by k-means, or ``refit``), each is also classified by the
    other's centres, and the two classifications of a half are compared by matched kappa. A half without a solution
    of k clusters leaves nulls and says so in Status."""
    dealt = kmeans.materialize(cases.select("id", "x").join(halves(cases, cases.count(), seed), "id"))
    fitted = kmeans.materialize((refit or of_kmeans(nstart, rounds, seed))(dealt, k, ("half",)))
    size = kmeans.dimensions(cases)
    centres = kmeans.centroids(fitted, size, ("half",)).withColumn("half", F.when(F.col("half") == "A", "B").otherwise("A"))
    other = kmeans.nearest(dealt, centres.select("half", "cluster", "center"), ("half",))
    table = agreement.crossed(fitted, other, ("half",))
    kappas = agreement.matched_kappa(table, ("half",))
    wide = kappas.agg(F.max(F.when(F.col("half") == "B", F.col("Kappa"))).alias("Kappa_half_B"), F.max(F.when(F.col("half") == "A", F.col("Kappa"))).alias("Kappa_half_A"), F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col("_n") == 2, "Completed").otherwise(f"a half has no solution of {k} clusters")
    return wide.select(F.lit(k).alias("K"), "Kappa_half_B", "Kappa_half_A", ((F.col("Kappa_half_B") + F.col("Kappa_half_A")) / 2).alias("Invariance"), status.alias("Status"))


def replicate_silhouettes(refits: DataFrame, name: str = "euclidean", weights: list[float] | None = None, ranges: list[float] | None = None) -> DataFrame:
    """(replicate, Silhouette): mean silhouette of ``refits(replicate, id, cluster, x[, n])`` under the distance.
    A case drawn several times, in rows of its own or n times in one, is as many cases; replicates with one cluster have no row."""
    copies = "n" if "n" in refits.columns else None
    sums = materialize(evaluate.case_cluster_sums(refits, name, weights, ranges, keys=("replicate",), copies=copies))
    if copies:
        widths = evaluate.silhouette(sums, ("replicate",)).join(refits.select("replicate", F.col("id").alias("ID"), "n"), ["replicate", "ID"])
        return widths.groupBy("replicate").agg((F.sum(F.col("Silhouette_width") * F.col("n")) / F.sum("n")).alias("Silhouette"))
    return evaluate.silhouette_summary(evaluate.silhouette(sums, ("replicate",)), ("replicate",)).select("replicate", "Silhouette")


def drawn_replicates(cases: DataFrame, replicates: int, seed: int = 2026, size: int | None = None) -> DataFrame:
    """(replicate, id, case, x), written: bootstrap samples of ``cases(id, x)``, or with ``size`` subsamples without replacement. ``id`` tells the copies
    of a case apart, ``case`` is its own id."""
    if size is not None:
        drawn = subsample(cases, size, replicates, seed).join(cases.select("id", "x"), "id")
        return kmeans.materialize(drawn.select("replicate", F.col("id").cast("string").alias("id"), F.col("id").alias("case"), "x"))
    index = kmeans.materialize(indexed(cases.select("id", "x")))
    drawn = bootstrap(index, index.count(), replicates, seed).join(index.select(F.col("id").alias("_id"), "x"), F.col("id") == F.col("_id"))
    return kmeans.materialize(drawn.select("replicate", F.concat_ws("-", "slot", "id").alias("id"), F.col("_id").alias("case"), "x"))


def counted_replicates(cases: DataFrame, replicates: int, seed: int = 2026) -> DataFrame:
    """(replicate, id, n, x), written: the bootstrap samples of ``drawn_replicates`` with a row for each case that was drawn and
    the number of its draws."""
    index = kmeans.materialize(indexed(cases.select("id", "x")))
    return kmeans.materialize(bootstrap_counts(index, index.count(), replicates, seed).join(index, "index").select("replicate", "id", "n", "x"))


def bootstrap_refits(cases: DataFrame, original: DataFrame, k: int, replicates: int, refit: Refit, seed: int = 2026, size: int | None = None, pair_indices: bool = False, name: str = "euclidean", weights: list[float] | None = None, ranges: list[float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stability of a partition under refits of all replicates together: (per cluster, agreement, by replicate).

    The last has a row per replicate with ARI and Rand, with ``pair_indices`` the mean silhouette of each refit, and Error where a
    refit gave fewer than k clusters: such replicates count as failed, and nowhere else. With ``size`` the replicates are
    subsamples. A refit that takes copies gets the draws of a case as one row with their number.
    """
    if size is None and getattr(refit, "takes_copies", False):
        fitted = kmeans.materialize(refit(counted_replicates(cases, replicates, seed), k, ("replicate",)))
        refits = fitted.select("replicate", "id", "cluster", "n")
    else:
        rows = drawn_replicates(cases, replicates, seed, size)
        fitted = kmeans.materialize(refit(rows, k, ("replicate",)))
        fitted = fitted if "case" in fitted.columns else kmeans.materialize(fitted.join(rows.select("replicate", "id", "case"), ["replicate", "id"]))
        refits = fitted.select("replicate", F.col("case").alias("id"), "cluster")
    each = kmeans.materialize(replicate_agreement(original, refits))
    failed = replicates - each.count()
    every = cases.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))
    table = every.join(each, "replicate", "left")
    if pair_indices:
        table = table.join(replicate_silhouettes(fitted, name, weights, ranges), "replicate", "left")
    table = table.withColumn("Error", F.when(F.col("Rand").isNull(), f"fewer than {k} clusters"))
    return stability(cluster_jaccard(original, refits), original, replicates, failed), agreement_summary(each, replicates), table


def bootstrap_kmeans(cases: DataFrame, original: DataFrame, k: int, replicates: int, seed: int = 2026, nstart: int = 5, rounds: int = 30, pair_indices: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``bootstrap_refits`` of k-means, the last table without the failed replicates."""
    stable, agreed, each = bootstrap_refits(cases, original, k, replicates, of_kmeans(nstart, rounds, seed), seed, pair_indices=pair_indices)
    return stable, agreed, each.where("Error is null").drop("Error")


def solution_indices(cases: DataFrame, keys: tuple[str, ...] = (), pair_indices: bool = False, ranks: bool = False, name: str = "euclidean", weights: list[float] | None = None, ranges: list[float] | None = None, euclidean: bool = True) -> DataFrame:
    """(keys, EESS, CH, DB) of ``cases(keys, id, cluster, x)`` if coordinates are ``euclidean``; ``pair_indices`` adds Silhouette, Dunn,
    Point_biserial and WB under the distance ``name``, and ``ranks`` C_index, Gamma and G_plus from numbers of pairs by distance."""
    parts = [evaluate.variance_indices(cases, keys)] if euclidean else []
    if pair_indices or ranks or not parts:
        sums = materialize(evaluate.case_cluster_sums(cases, name, weights, ranges, keys=keys))
        parts += [evaluate.silhouette_summary(evaluate.silhouette(sums, keys), keys).drop("Negative_silhouette_pct"), evaluate.pair_indices(sums, keys)]
    if ranks:
        parts.append(evaluate.indices_of_histogram(evaluate.distance_counts(cases, name, weights, ranges, keys), keys))
    made = parts[0]
    for more in parts[1:]:
        made = made.join(more, list(keys), "left") if keys else made.crossJoin(more)
    return made


def null_replicates(cases: DataFrame, variables: list[str], replicates: int, seed: int = 2026, null: str = "permutation") -> DataFrame:
    """(replicate, id, variables): null data of ``cases(id, variables)`` by column permutation or from one Gaussian."""
    if null == "permutation":
        return permuted(indexed(cases), variables, replicates, seed).withColumnRenamed("index", "id")
    return gaussian(cases, variables, replicates, seed)


def simulate_refits(data: DataFrame, observed: DataFrame, k: int, replicates: int, refit: Refit, name: str = "euclidean", weights: list[float] | None = None, ranges: list[float] | None = None, euclidean: bool = True) -> DataFrame:
    """Empirical p values of the indices that ``observed``, one row of ``solution_indices``, has, against refits of the null
    ``data(replicate, id, x)``. Replicates whose refit gave fewer than k clusters are failed ones."""
    fitted = kmeans.materialize(refit(kmeans.materialize(data), k, ("replicate",)))
    names = observed.columns
    indices = solution_indices(fitted, ("replicate",), "Silhouette" in names, "Gamma" in names, name, weights, ranges, euclidean)
    long = lambda df, *keys: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("Index"), F.col(i).alias("value")) for i in names])).alias("r")).select(*keys, "r.*")
    return empirical_p(long(observed), long(indices, "replicate"), replicates)


def simulate_kmeans(cases: DataFrame, variables: list[str], observed: DataFrame, k: int, replicates: int, seed: int = 2026, null: str = "permutation", nstart: int = 5, rounds: int = 30) -> DataFrame:
    """``simulate_refits`` of k-means on null data of ``cases(id, variables)``."""
    data = null_replicates(cases, variables, replicates, seed, null).select("replicate", "id", F.array(*variables).alias("x"))
    return simulate_refits(data, observed, k, replicates, of_kmeans(nstart, rounds, seed))
