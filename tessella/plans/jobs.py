"""Whole analyses: prepare, cluster for each k, evaluate, compare, choose, profile."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import HIERARCHICAL, ClusterConfig
from tessella.functions import distance as dist
from tessella.operators import describe, evaluate, groups, impute, kmeans, linkage, mixture, prepare, profile, refit, resample, schedule, select, spanning
from tessella.session import materialize

#: Pair jobs refuse more pairs than this; ``max_pairs`` raises it.
MAX_PAIRS = 2_000_000_000
#: Up to so many pairs, hierarchies that merge in rounds are exact on any distance; beyond, they run on representatives.
EXACT_PAIRS = 200_000_000
HYBRIDS = ("ward_relocate", "hybrid_kmeans", "hybrid_relocate", "hybrid_pam")


@dataclass
class Analysis:
    config: ClusterConfig
    prepared: prepare.Prepared
    memberships: DataFrame  # k, id, cluster
    comparison: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    suggested: int | None = None


def metric(p: prepare.Prepared) -> tuple[str, list[float] | None, list[float] | None]:
    """Name, weights and ranges of the distance of the prepared cases."""
    name = "euclidean" if p.config.distance == "mahalanobis" else p.config.distance
    return name, list(p.weights) if name in ("gower", *dist.BINARY) else None, p.ranges


def pairs_of(p: prepare.Prepared, max_pairs: int = MAX_PAIRS) -> DataFrame:
    n = p.cases.count()
    if n * (n - 1) // 2 > max_pairs:
        raise ValueError(f"{n} cases make more than {max_pairs} pairs: use a method for coordinates, or raise max_pairs")
    made = dist.pairs(p.cases, *metric(p), blocks=max(4, round(n**0.5 / 64)))
    return dist.fill_unknown(materialize(made)) if p.config.missing == "available" else made


def _in_rounds(p: prepare.Prepared, method: str) -> bool:
    """Whether a hierarchy is made exactly, from all pairs: more cases than representatives, but not too many pairs."""
    c, reducible = p.config, method == "single" or (method in linkage.REDUCIBLE and not (method == "flexible" and p.config.beta > 0))
    if p.euclidean or c.distance == "mahalanobis" or not reducible or method not in HIERARCHICAL:
        return False
    n = p.cases.count()
    return n > c.representatives and n * (n - 1) // 2 <= EXACT_PAIRS


def _by_blocks(p: prepare.Prepared, method: str) -> bool:
    """Whether single linkage is made exactly without pairs: more cases than representatives, and a distance that boxes bound."""
    if method != "single" or p.config.missing == "available" or _box_name(p) not in spanning.BOXED:
        return False
    return p.cases.count() > p.config.representatives


def _box_name(p: prepare.Prepared) -> str:
    return "euclidean" if metric(p)[0] == "minkowski" else metric(p)[0]


def tree_edges(p: prepare.Prepared) -> DataFrame:
    """(i, j, d): the edges of the spanning tree, whose single linkage is that of all pairs."""
    return spanning.block_tree(p.cases.select("id", "x"), _box_name(p)).withColumnRenamed("height", "d")


def fit(p: prepare.Prepared, ks: list[int], pairs: DataFrame | None = None, criteria: dict[int, DataFrame] | None = None, notes: list[tuple[int | None, str]] | None = None, starts: dict[int, float] | None = None) -> DataFrame:
    """(k, id, cluster) for each k by the configured method; one hierarchy serves every k. k = 1 is one cluster, except
    for mixtures, which are fitted and leave one row of their criteria for each k in ``criteria``.

    k-means searches random starts, as many k-means++ starts and the Ward partition of representatives. What needs
    all distances runs on the cases while they are no more than ``config.representatives``, else on representatives
    (exactly, for linkages that merge in rounds on up to EXACT_PAIRS pairs). A k without a solution of k clusters has
    no rows. ``notes`` gets warnings, ``starts`` the objectives of the partitions that hybrids start from.
    """
    c, cases = p.config, p.cases.select("id", "x")
    notes, starts = [] if notes is None else notes, {} if starts is None else starts
    many = [k for k in ks if k > 1 or c.method == "gmm"]
    parts = [cases.select(F.lit(1).alias("k"), "id", F.lit(1).alias("cluster"))] if 1 in ks and c.method != "gmm" else []
    for k in many:
        profile.check_profiles(p.cases, p.variables, k)
    if c.method == "gmm":
        for k in many:
            made, mix = mixture.gmm(cases, k, c.covariance, c.max_iter, c.seed)
            made = materialize(made)
            if not mix.converged:
                notes.append((k, f"the mixture {mix.model} had not converged after {mix.rounds} rounds"))
            if criteria is not None:
                probs = made.select("id", F.posexplode("prob").alias("cluster", "prob"))
                criteria[k] = materialize(evaluate.mixture_criteria(probs, mix.log_likelihood, mix.parameters))
            parts.append(made.select(F.lit(k).alias("k"), "id", "cluster"))
    elif c.method == "kmeans":
        ward = groups.grouped_fit(cases, "ward.D2", many, count=c.representatives, seed=c.seed) if many else None
        for k in many:
            placed = cases.join(ward.where(F.col("k") == k).select("id", "cluster"), "id")
            extra = kmeans.centroids(placed, kmeans.dimensions(cases)).select(F.lit(0).alias("start"), "cluster", "center")
            parts.append(kmeans.kmeans(cases, k, c.nstart, c.max_iter, c.seed, extra=materialize(extra), plus_plus=c.nstart).select(F.lit(k).alias("k"), "id", "cluster"))
    elif _by_blocks(p, c.method) or _in_rounds(p, c.method):
        parts.append(tree_cuts(p, many, c.method, pairs))
    elif many:
        made = materialize(groups.grouped_fit(cases, c.method, many, metric(p)[0], c.representatives, *metric(p)[1:], beta=c.beta, hybrid_start=c.hybrid_start, max_iter=c.max_iter, seed=c.seed, algorithm=c.hybrid_algorithm, starts=True))
        starts |= {r["k"]: r["start"] for r in made.where("start is not null").select("k", "start").distinct().collect()}
        if c.method in ("ward_relocate", "hybrid_kmeans", "hybrid_relocate") and p.cases.count() > c.representatives:
            # The representatives' solution is only a start: all cases are refined.
            parts += [refine(p, made.where(F.col("k") == k).select("id", "cluster"), k) for k in many]
        else:
            parts.append(made.select("k", "id", "cluster"))
    if not parts:
        return cases.select(F.lit(0).alias("k"), "id", F.lit(0).alias("cluster")).limit(0)
    made = parts[0]
    for df in parts[1:]:
        made = made.unionByName(df.select("k", "id", "cluster"))
    return made.select("k", "id", F.col("cluster").cast("int").alias("cluster"))


def tree_cuts(p: prepare.Prepared, ks: list[int], method: str, pairs: DataFrame | None = None) -> DataFrame:
    """Exact hierarchy on the pairs of any distance, or on the edges of a spanning tree, cut at each k."""
    ids = p.cases.select("id")
    if _by_blocks(p, method):
        matrix = pairs if pairs is not None else tree_edges(p)
        merges, ends = materialize(matrix.withColumnRenamed("d", "height")), ("i", "j")
        cuts = [linkage.cut(ids, merges, k, ends).select(F.lit(k).alias("k"), "id", "cluster") for k in ks]
        return reduce(DataFrame.unionByName, cuts)
    matrix = materialize(pairs if pairs is not None else pairs_of(p))
    if method == "single":
        merges, ends = linkage.spanning_tree(matrix, ids), ("i", "j")
    else:
        merges, ends = materialize(linkage.mutual_merges(matrix, ids, method, p.config.beta)), ("a", "b")
    cuts = [linkage.cut(ids, merges, k, ends).select(F.lit(k).alias("k"), "id", "cluster") for k in ks]
    made = cuts[0]
    for c in cuts[1:]:
        made = made.unionByName(c)
    return made


def tree_of(config: ClusterConfig) -> str | None:
    """The linkage of the tree that a method builds, if it builds one."""
    if config.method in HIERARCHICAL:
        return config.method
    return "ward.D2" if config.method == "ward_relocate" else config.hybrid_start if config.method in HYBRIDS else None


def merges_of(p: prepare.Prepared, pairs: DataFrame | None = None) -> DataFrame:
    """(stage, a, b, height, first_a, first_b, n) of the tree of the configured method, written."""
    c, method = p.config, tree_of(p.config)
    if _by_blocks(p, method):
        edges = pairs if pairs is not None and c.method == "single" else tree_edges(p)
        merges = spanning.last_merges(edges.withColumnRenamed("d", "height"), p.cases.select("id"), c.representatives)
    elif _in_rounds(p, method):
        merges = linkage.mutual_merges(pairs if pairs is not None else pairs_of(p), p.cases.select("id"), method, c.beta)
    else:
        merges = groups.grouped_tree(p.cases.select("id", "x"), method, metric(p)[0], c.representatives, *metric(p)[1:], beta=c.beta, seed=c.seed)
    return materialize(schedule.stages(materialize(merges)))


def agglomeration(p: prepare.Prepared, pairs: DataFrame | None = None) -> DataFrame:
    """The agglomeration schedule of the tree of the configured method: of the cases, or of their
    representatives, named by their first case."""
    return schedule.agglomeration(merges_of(p, pairs), tree_of(p.config))


def dendrogram(p: prepare.Prepared, staged: DataFrame, partition: DataFrame, k: int) -> dict[str, DataFrame]:
    """Leaf order, cut height and runs of clusters along the leaves of a tree and a partition of its cases."""
    leaves = materialize(schedule.leaf_order(staged).join(partition, "id").select("position", "id", "cluster"))
    return {"Leaf_order": leaves, "Leaf_runs": schedule.leaf_runs(leaves), "Cut_height": schedule.cut_height(staged.select("stage", "height"), k)}


def refine(p: prepare.Prepared, start: DataFrame, k: int) -> DataFrame:
    """A starting partition improved by k-means or relocation over all cases."""
    cases, c = p.cases.select("id", "x"), p.config
    placed = materialize(cases.join(start, "id"))
    if c.method == "hybrid_kmeans":
        centres = kmeans.lloyd(cases, materialize(kmeans.centroids(placed, kmeans.dimensions(cases)).select("cluster", "center")), c.max_iter)
        placed = materialize(kmeans.nearest(cases, centres).select("id", "x", "cluster"))
    if c.method != "hybrid_kmeans" or c.hybrid_algorithm == "Hartigan-Wong":
        placed = kmeans.relocate(placed, c.max_iter)[0]
    return kmeans.renumbered(placed).select(F.lit(k).alias("k"), "id", "cluster")


def evaluate_solution(p: prepare.Prepared, partition: DataFrame, k: int, pair_indices: bool = True, ranks: bool | None = None, keep: dict[int, DataFrame] | None = None) -> DataFrame:
    """One row of the comparison table. ``pair_indices`` adds silhouettes and the indices over pairs, which are added up in
    blocks, no pair being written; ``ranks`` (as pair_indices, if not given) C-index, Gamma and G-plus. ``keep`` gets the silhouettes of k."""
    cases = materialize(p.cases.select("id", "x").join(partition, "id"))
    row = evaluate.sizes(cases)
    if p.euclidean:
        row = row.crossJoin(evaluate.variance_indices(cases))
    if k > 1 and pair_indices:
        sums = evaluate.case_cluster_sums(cases, *metric(p))
        sums = materialize(evaluate.with_unknown(materialize(sums), cases) if p.config.missing == "available" else sums)
        widths = materialize(evaluate.silhouette(sums))
        if keep is not None:
            keep[k] = widths
        row = row.crossJoin(evaluate.silhouette_summary(widths)).crossJoin(evaluate.pair_indices(sums))
        if pair_indices if ranks is None else ranks:
            unknown = max(1.0, sums.agg(F.max("high")).first()[0] or 1.0) if p.config.missing == "available" else None
            row = row.crossJoin(evaluate.indices_of_histogram(evaluate.distance_counts(cases, *metric(p), unknown=unknown)))
    elif k > 1 and p.config.distance == "sqeuclidean":  # in closed form
        widths = evaluate.silhouette(evaluate.squared_sums(cases))
        row = row.crossJoin(evaluate.silhouette_summary(widths))
    return row.withColumn("Status", F.lit("Completed"))


def _reason(e: Exception) -> str:
    return next((line for line in str(e).splitlines() if line.strip()), type(e).__name__)[:300]


def analyse(df: DataFrame, config: ClusterConfig, pair_indices: bool = True, validation: bool = False, describe_solution: bool = True) -> Analysis:
    """Prepare the cases, cluster them for k_min..k_max, evaluate and compare the solutions, and suggest a k.

    A k that fails is recorded with its message and the others go on. ``validation`` adds bootstrap (or subsampling), null
    simulation, replication and the gap statistic, with refits by the configured method. Indices over pairs
    are left out, with a warning, beyond MAX_PAIRS pairs; C-index, Gamma and G-plus beyond EXACT_PAIRS. Without
    ``describe_solution`` there are no tables but the comparison. With ``missing="multiple"`` see ``analyse_imputations``.
    """
    if config.missing == "multiple":
        return analyse_imputations(df, config, pair_indices, validation)
    spark = df.sparkSession
    notes: list[tuple[int | None, str]] = []
    p = prepare.prepare(df, config)
    p = replace(p, cases=materialize(p.cases))
    n = p.cases.count()
    ks = [k for k in range(config.k_min, min(config.k_max, n - 1) + 1)]
    size, ranks = n * (n - 1) // 2, pair_indices
    if pair_indices and size > EXACT_PAIRS:
        ranks = False
        notes.append((None, f"C-index, Gamma and G-plus left out: {n} cases make more than {EXACT_PAIRS} pairs"))
    if pair_indices and size > MAX_PAIRS:
        pair_indices = False
        notes.append((None, f"indices over pairs left out: {n} cases make more than {MAX_PAIRS} pairs"))
    pairs = materialize(tree_edges(p)) if _by_blocks(p, config.method) else materialize(pairs_of(p)) if _in_rounds(p, config.method) else None
    rows, fitted, checks = [], [], {}
    criteria: dict[int, DataFrame] = {}
    starts: dict[int, float] = {}
    widths: dict[int, DataFrame] = {}

    def failed(k: int, why: str) -> DataFrame:
        return spark.range(1).select(F.lit(k).cast("bigint").alias("K"), F.lit(n).cast("bigint").alias("N"), F.lit(why).alias("Status"))

    for group in [[k] for k in ks] if config.method in ("kmeans", "gmm") else [ks]:
        try:
            made = materialize(fit(p, group, pairs, criteria, notes, starts))
        except Exception as e:  # whatever a fit fails for is recorded with its k, and the others go on
            rows += [failed(k, _reason(e)) for k in group]
            continue
        solved = {r[0] for r in made.select("k").distinct().collect()}
        for k in group:
            part = made.where(F.col("k") == k).select("id", "cluster")
            try:
                if k not in solved:
                    raise ValueError(f"the fit has fewer than {k} clusters: use a smaller k or another method")
                row = evaluate_solution(p, part, k, pair_indices, ranks, widths)
                if k in criteria:
                    row = row.crossJoin(criteria[k])
                if validation and k > 1:
                    checks[k] = {name: materialize(t) for name, t in validate(p, part, k, pair_indices=pair_indices, notes=notes).items()}
                    row = row.crossJoin(validation_row(checks[k]))
                rows.append(materialize(row))
                fitted.append(part.select(F.lit(k).alias("k"), "id", "cluster"))
            except Exception as e:
                checks.pop(k, None)
                rows.append(failed(k, _reason(e)))
    comparison = materialize(select.comparison(rows))
    if not fitted:
        raise ValueError("no solution could be fitted: " + "; ".join(sorted({r[0] for r in comparison.select("Status").collect()})))
    memberships = fitted[0]
    for m in fitted[1:]:
        memberships = memberships.unionByName(m)
    memberships = materialize(memberships)
    done = sorted(r["k"] for r in memberships.select("k").distinct().collect())
    best = select.best_k(select.long_indices(comparison))
    gap = voted = None
    if validation and not p.euclidean:
        notes.append((None, "Gap statistic not computed: it needs Euclidean or squared Euclidean distance"))
    elif validation:
        gap = materialize(resample.gap(p.cases.select("id", "x"), min(config.k_max, n - 1), config.gap_B, config.seed, refit=refit.of_method(config)))
        voted = materialize(resample.gap_candidate(gap))
        gap = gap.crossJoin(F.broadcast(voted.select(F.col("K").alias("candidate"))))
    suggested = select.suggested_k(best, done, voted).first()["K"]
    if not describe_solution:
        return Analysis(config, p, memberships, comparison, {"Comparison": comparison}, suggested)
    tables = {
        "Descriptives": profile.describe(df, list(config.variables)),
        "Missingness": profile.missingness(df, list(config.variables)),
        "Missing_patterns": profile.missing_patterns(df, list(config.variables)),
        "Case_audit": p.audit,
        "Comparison": comparison,
        "Fit_indices": select.fit_indices(comparison, done, gap),
        "Findings": select.findings(comparison.where(F.col("K") == suggested)),
        "Index_series": select.index_series(select.long_indices(comparison)),
    }
    if len(done) > 1:
        tables["Close_second"] = select.close_second(select.votes(best, voted), suggested)
    if tree_of(config):
        staged = merges_of(p, pairs)
        tables["Agglomeration"] = materialize(schedule.agglomeration(staged, tree_of(config)))
        tables["Largest_increases"] = schedule.largest_increase(tables["Agglomeration"], done, 2)
        tables |= dendrogram(p, staged, memberships.where(F.col("k") == suggested).select("id", "cluster"), suggested)
    if starts:
        tables["Starting_partitions"] = spark.createDataFrame([(k, tree_of(config), v) for k, v in sorted(starts.items())], "K int, Start string, Objective double")
    if gap is not None:
        tables["Gap"] = gap.drop("candidate")
    for name in {name: None for t in checks.values() for name in t}:
        parts = [t[name] if "K" in t[name].columns else t[name].select(F.lit(k).alias("K"), "*") for k, t in checks.items() if name in t]
        tables[name] = select.comparison(parts)
    if p.donors is not None:
        tables["Donors"] = p.donors
    if suggested in widths:
        tables["Silhouette"] = widths[suggested]
        tables["Silhouette_order"] = schedule.silhouette_order(widths[suggested])
    if notes:
        tables["Warnings"] = select.warnings_log(spark.createDataFrame(notes, "K int, Message string"))
    tables |= solution_tables(p, df, memberships, suggested)
    return Analysis(config, p, memberships, comparison, tables, suggested)


def solution_tables(p: prepare.Prepared, df: DataFrame, memberships: DataFrame, k: int) -> dict[str, DataFrame]:
    chosen = memberships.where(F.col("k") == k).select("id", "cluster")
    cases = materialize(p.cases.join(chosen, "id"))
    variables = list(p.variables)
    more = [v for v in p.config.illustrative if v not in variables]
    if more:
        extra = df.select(F.col(p.config.id).alias("id"), *more)
        for v in more:
            extra = prepare.as_continuous(extra, v)
        cases = materialize(cases.join(extra, "id"))
    tests = describe.with_p(describe.variance_tests(cases, variables + more))
    role = F.when(F.col("Variable").isin(*variables), "active").otherwise("illustrative")
    tables = {}
    if p.config.distance not in ("gower", *dist.BINARY, *dist.COUNT):
        scored, explained = describe.principal_components(cases, variables, min(2, len(variables)))
        shares = [F.lit(v).alias(f"Explained_{i + 1}") for i, v in enumerate(explained)]
        tables["Projection"] = scored.select("id", "cluster", *[f"PC{i + 1}" for i in range(len(explained))], *shares)
        tables["Heat_map"] = describe.heat_map(cases, variables)
    else:
        placed = describe.landmark_scaling(cases.select("id", "x"), *metric(p), seed=p.config.seed)
        tables["Projection"] = placed.join(chosen, "id")
    return tables | {
        "Top_variables": describe.top_eta(tests.where(F.col("Variable").isin(*variables))),
        "Centroids": evaluate.centres_and_spread(cases, variables),
        "Clusters": evaluate.clusters(cases),
        "Profiles": describe.profiles(cases, variables + more),
        "Variable_tests": tests.withColumn("Role", role),
        "Pairwise_comparisons": describe.with_tukey(describe.pairwise_differences(cases, variables + more)).withColumn("Role", role),
        "Z_profiles": describe.z_profiles(cases, variables),
    }


def scaled_copies(completed: DataFrame, config: ClusterConfig) -> DataFrame:
    """(imputation, id, x) of completed copies, each scaled on its own."""
    model = prepare.scale_model(completed, list(config.variables), config.scaling, ("imputation",))
    wide = model.groupBy("imputation").pivot("Variable", list(config.variables)).agg(F.first(F.struct("Center", "Scale")))
    wide = wide.select("imputation", *[F.col(v).alias(f"_m_{v}") for v in config.variables])
    weights = zip(config.variables, config.weight())
    return completed.join(F.broadcast(wide), "imputation").select("imputation", "id", F.array(*[(F.col(v) - F.col(f"_m_{v}.Center")) / F.col(f"_m_{v}.Scale") * float(w**0.5) for v, w in weights]).alias("x"))


def multiple_imputation(df: DataFrame, config: ClusterConfig, k: int) -> tuple[DataFrame, DataFrame]:
    """(memberships by imputation, consensus of pairs) of numeric variables: each completed copy is scaled and clustered by
    the configured method, all copies in the same rounds."""
    coded = prepare.encode(df.select(F.col(config.id).alias("id"), *config.variables), config)
    completed = impute.multiple_impute(coded, list(config.variables), config.mi_m, config.mi_iter, config.seed)
    z = materialize(scaled_copies(completed, config))
    if config.method == "kmeans":
        made = kmeans.kmeans(z, k, config.nstart, config.max_iter, config.seed, keys=("imputation",))
    else:
        made = refit.of_method(config)(z, k, ("imputation",))
    members = materialize(made.select("imputation", "id", "cluster"))
    return members, impute.consensus(members)


def analyse_imputations(df: DataFrame, config: ClusterConfig, pair_indices: bool = True, validation: bool = False) -> Analysis:
    """``analyse`` of each of ``config.mi_m`` completed copies, everything else unchanged but for the gap statistic, which is not
    defined across copies.

    Numeric variables are imputed by predictive means, text of two values by logistic and of more by multinomial regression. The
    analysis of the last copy is returned; its table MI_fit_summary has the comparisons of all copies, MI_classes,
    MI_class_members and MI_consensus the consensus at the largest k between classes of cases that no copy tells apart,
    and Case_audit the original gaps and the average number of cells filled in.
    """
    spark, variables = df.sparkSession, list(config.variables)
    profile.check_key(df, config.id)
    values = df.select(F.col(config.id).alias("id"), *variables)
    completed = impute.multiple_impute(values, variables, config.mi_m, config.mi_iter, config.seed)
    others = df.drop(*variables)
    each, rows, members = replace(config, missing="complete"), [], []
    for i in range(1, config.mi_m + 1):
        copy = completed.where(F.col("imputation") == i).drop("imputation").withColumnRenamed("id", config.id)
        made = analyse(materialize(others.join(copy, config.id).select(*df.columns)), each, pair_indices, validation, describe_solution=i == config.mi_m)
        rows.append(made.comparison.select(F.lit(i).alias("Imputation"), "*"))
        top = made.memberships.agg(F.max("k")).first()[0]
        members.append(made.memberships.where(F.col("k") == top).select(F.lit(i).alias("imputation"), "id", "cluster"))
    together = members[0]
    for m in members[1:]:
        together = together.unionByName(m)
    classes, inside, pairs = impute.consensus_classes(materialize(together))
    filled = impute.imputed_cells(values, completed, variables)
    status = made.tables["Case_audit"].select("ID", "Status")
    made.tables |= {
        "MI_fit_summary": materialize(select.comparison(rows)), "MI_classes": classes, "MI_class_members": inside, "MI_consensus": pairs,
        "MI_scope": spark.createDataFrame([(config.mi_m, "resampling is conditional on each copy; the solution shown is that of the last copy; consensus is for the largest k")], "Copies int, Scope string"),
        "Descriptives": profile.describe(df, variables), "Missingness": profile.missingness(df, variables), "Missing_patterns": profile.missing_patterns(df, variables),
        "Case_audit": filled.join(status, "ID"),
    }
    return replace(made, config=config)


def null_data(p: prepare.Prepared, replicates: int) -> DataFrame:
    """(replicate, id, x): null data of prepared cases under the configured reference, ready for its distance."""
    c = p.config
    numeric = c.distance not in ("gower", *dist.BINARY, *dist.COUNT)
    if c.null == "gaussian" and not numeric:
        raise ValueError("the Gaussian null needs numeric variables and no binary or count distance")
    names = [f"v{i}" for i in range(len(p.variables))]
    if c.distance == "mahalanobis":  # unwhitened, as each replicate has a covariance of its own
        raw = p.cases.select("id", *[F.col(v).alias(a) for v, a in zip(p.variables, names)])
        drawn = materialize(resample.null_replicates(raw, names, replicates, c.seed, c.null))
        return dist.whiten_keys(drawn, names, ("replicate",)).select("replicate", "id", "x")
    z = p.cases.select("id", *[F.col("x")[i].alias(a) for i, a in enumerate(names)])
    return resample.null_replicates(z, names, replicates, c.seed, c.null).select("replicate", "id", F.array(*names).alias("x"))


def validate(p: prepare.Prepared, partition: DataFrame, k: int, replicates: int | None = None, pair_indices: bool = False, notes: list[tuple[int | None, str]] | None = None) -> dict[str, DataFrame]:
    """Bootstrap (or subsample) stability, null simulation and split-half replication of a solution, with refits by its method;
    ``pair_indices`` adds those that need distances within each replicate. What a distance does not allow is noted."""
    cases, b, c = p.cases.select("id", "x"), replicates or p.config.B, p.config
    notes = [] if notes is None else notes
    again = refit.of_method(c, p.ranges)
    size = resample.subsample_size(cases.count(), c.k_max, c.fraction) if c.subsample else None
    name, weights, ranges = metric(p)
    stability, agreement, each = resample.bootstrap_refits(cases, partition, k, b, again, c.seed, size, pair_indices, name, weights, ranges)
    tables = {"Bootstrap": stability, "Bootstrap_agreement": agreement, "Bootstrap_replicates": each}
    placed = materialize(cases.join(partition, "id"))
    observed = materialize(resample.solution_indices(placed, (), pair_indices, False, name, weights, ranges, p.euclidean))
    try:
        tables["Simulation"] = resample.simulate_refits(null_data(p, b), observed, k, b, again, name, weights, ranges, p.euclidean)
    except ValueError as e:
        notes.append((k, f"Null simulation not computed: {e}"))
    if c.distance == "gower" and c.missing == "available":
        notes.append((k, "Split-half replication not computed: it needs numeric variables without missing values"))
    else:
        tables["Replication"] = resample.split_half(cases, k, c.seed, refit=again)
    return tables


def validation_row(tables: dict[str, DataFrame]) -> DataFrame:
    """What the comparison table has of ``validate``'s tables: one row."""
    stability, agreed = tables["Bootstrap"], tables["Bootstrap_agreement"]
    of = lambda i, c, name: F.max(F.when(F.col("Index") == i, F.col(c))).alias(name)
    row = stability.agg(F.avg("Mean_Jaccard").alias("Bootstrap_mean_Jaccard"), F.min("Mean_Jaccard").alias("Bootstrap_min_Jaccard"), F.min("Valid_B").alias("Bootstrap_valid_B"), F.min("Completed_B").alias("Bootstrap_completed_B"))
    row = row.crossJoin(agreed.agg(*[of(i, c, f"Bootstrap_{i}{end}") for i in ("ARI", "Rand") for c, end in (("Mean", ""), ("P025", "_P025"), ("P975", "_P975"))]))
    if "Simulation" in tables:
        row = row.crossJoin(tables["Simulation"].agg(*[of(i, "Empirical_p", f"Simulation_p_{i}") for i in ("Silhouette", "CH", "EESS")], F.max(F.when(F.col("Index") == "Silhouette", F.col("Valid_B"))).alias("Simulation_valid_B")))
    if "Replication" in tables:
        row = row.crossJoin(tables["Replication"].select("Invariance"))
    return row


def as_pandas(analysis: Analysis, table: str, rows: int = 200) -> pd.DataFrame:
    """The first rows of a result table, for display."""
    return analysis.tables[table].limit(rows).toPandas()
