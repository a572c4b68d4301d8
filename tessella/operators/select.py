"""Choosing the number of clusters from a comparison table with one row per k.

These tables have a row per k and index, a few hundred at most; windows over them are bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IndexSpec:
    column: str
    label: str
    better: str | None = None


# The indices of the comparison table in report order, their labels and directions.
SPEC = (
    IndexSpec("N", "Cases analyzed"),
    IndexSpec("Minimum_N", "Smallest cluster"),
    IndexSpec("Singletons", "Single-case clusters"),
    IndexSpec("EESS", "Explained variance (EESS %)"),
    IndexSpec("Silhouette", "Mean silhouette", "higher"),
    IndexSpec("Negative_silhouette_pct", "Negative silhouettes %", "lower"),
    IndexSpec("CH", "Calinski-Harabasz", "higher"),
    IndexSpec("DB", "Davies-Bouldin", "lower"),
    IndexSpec("Dunn", "Dunn", "higher"),
    IndexSpec("Point_biserial", "Point-biserial correlation", "higher"),
    IndexSpec("C_index", "C-index", "lower"),
    IndexSpec("Gamma", "Goodman-Kruskal Gamma", "higher"),
    IndexSpec("G_plus", "G-plus", "lower"),
    IndexSpec("WB", "Within/between distance ratio", "lower"),
    IndexSpec("Log_likelihood", "Log likelihood"),
    IndexSpec("Parameters", "Parameters"),
    IndexSpec("AIC", "AIC", "lower"),
    IndexSpec("BIC", "BIC", "lower"),
    IndexSpec("SABIC", "Sample-size adjusted BIC", "lower"),
    IndexSpec("CAIC", "CAIC", "lower"),
    IndexSpec("Relative_entropy", "Relative entropy", "higher"),
    IndexSpec("Mean_max_posterior", "Mean maximum posterior", "higher"),
    IndexSpec("Bootstrap_mean_Jaccard", "Bootstrap Jaccard, mean of clusters", "higher"),
    IndexSpec("Bootstrap_min_Jaccard", "Bootstrap Jaccard, least stable cluster", "higher"),
    IndexSpec("Bootstrap_ARI", "Bootstrap adjusted Rand index", "higher"),
    IndexSpec("Bootstrap_ARI_P025", "Bootstrap ARI 2.5%"),
    IndexSpec("Bootstrap_ARI_P975", "Bootstrap ARI 97.5%"),
    IndexSpec("Bootstrap_Rand", "Bootstrap Rand index", "higher"),
    IndexSpec("Bootstrap_Rand_P025", "Bootstrap Rand 2.5%"),
    IndexSpec("Bootstrap_Rand_P975", "Bootstrap Rand 97.5%"),
    IndexSpec("Bootstrap_valid_B", "Bootstrap valid replications"),
    IndexSpec("Simulation_p_Silhouette", "Null simulation p, silhouette", "lower"),
    IndexSpec("Simulation_p_CH", "Null simulation p, Calinski-Harabasz", "lower"),
    IndexSpec("Simulation_p_EESS", "Null simulation p, EESS", "lower"),
)
POSTERIOR = ("Relative_entropy", "Mean_max_posterior")
EXTERNAL = r"^(Bootstrap|Null simulation)"


def spec_table(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("position"), F.lit(s.column).alias("column"), F.lit(s.label).alias("Index"), F.lit(s.better).cast("string").alias("Better")) for i, s in enumerate(SPEC)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def comparison(per_k: list[DataFrame]) -> DataFrame:
    """One row per k, the union of all columns; a k that failed carries its message in Status."""
    out = per_k[0]
    for df in per_k[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def warnings_log(messages: DataFrame) -> DataFrame:
    """(K, Message, Occurrences) of ``messages(K, Message)``."""
    return messages.groupBy("K", "Message").agg(F.count(F.lit(1)).alias("Occurrences"))


def long_indices(comparison: DataFrame) -> DataFrame:
    """(position, column, Index, Better, K, value, Singletons) of the columns that are present."""
    present = [s.column for s in SPEC if s.column in comparison.columns]
    single = F.col("Singletons").cast("double") if "Singletons" in comparison.columns else F.lit(None).cast("double")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in present]))
    long = comparison.select("K", single.alias("Singletons"), values.alias("v")).select("K", "Singletons", "v.*")
    return long.join(F.broadcast(spec_table(comparison.sparkSession)), "column")


def best_k(long: DataFrame) -> DataFrame:
    """(position, column, Index, Better, Best_k) of the indices that have a value.

    Best is the highest or lowest value within 1e-12 relative, among solutions without single-case
    clusters (unless all of k > 1 have them); k = 1 is left out for posterior indices. Fewer than two
    candidates or all alike: blank; more than three best: ``tie``.
    """
    alone = F.coalesce(F.col("Singletons"), F.lit(0.0)) != 0
    every = Window.partitionBy("column")
    none_left = F.count_if((F.col("K") > 1) & ~alone).over(every) == 0
    candidate = F.col("value").isNotNull() & ~(F.col("column").isin(*POSTERIOR) & (F.col("K") == 1)) & (~alone | none_left)
    marked = long.withColumn("_c", F.when(candidate, F.col("value")))
    target = F.when(F.col("Better") == "higher", F.max("_c").over(every)).otherwise(F.min("_c").over(every))
    hit = (F.col("_c") == F.col("_t")) | (F.abs(F.col("_c") - F.col("_t")) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("_t")))
    grouped = marked.withColumn("_t", target).groupBy("position", "column", "Index", "Better").agg(
        F.count("value").alias("_values"), F.count("_c").alias("_n"), F.array_sort(F.collect_list(F.when(hit, F.col("K")))).alias("_hits")
    )
    best = F.when(F.col("Better").isNull() | (F.col("_n") < 2) | (F.size("_hits") >= F.col("_n")), "").when(F.size("_hits") > 3, "tie").otherwise(F.array_join(F.transform("_hits", lambda k: k.cast("string")), ", "))
    return grouped.where("_values > 0").select("position", "column", "Index", F.coalesce("Better", F.lit("")).alias("Better"), best.alias("Best_k"))


def fit_indices(comparison: DataFrame, ks: list[int], gap: DataFrame | None = None) -> DataFrame:
    """Index, Better, ``k = ...`` for each k, Best_k: one row per index, then Gap and its standard error from
    ``gap(K, gap, SE, candidate)``."""
    long = long_indices(comparison)
    wide = long.groupBy("position").pivot("K", ks).agg(F.first("value"))
    made = best_k(long).join(wide, "position")
    if gap is not None:
        rows = F.explode(F.array(
            F.struct(F.lit(100).alias("position"), F.lit("Gap statistic").alias("Index"), F.col("gap").alias("value")),
            F.struct(F.lit(101).alias("position"), F.lit("Gap standard error").alias("Index"), F.col("SE").alias("value")),
        ))
        inside = F.when(F.col("candidate").isin(*ks), F.col("candidate").cast("string")).otherwise(F.concat(F.col("candidate").cast("string"), F.lit(" (outside range)")))
        long_gap = gap.select("K", inside.alias("_best"), rows.alias("r")).select("K", "_best", "r.*")
        wide_gap = long_gap.groupBy("position", "Index", "_best").pivot("K", ks).agg(F.first("value"))
        made = made.unionByName(wide_gap.withColumn("Best_k", F.when(F.col("position") == 100, F.col("_best")).otherwise("")).withColumn("Better", F.lit("")).withColumn("column", F.lit("Gap")).drop("_best"))
    return made.orderBy("position").select("Index", "Better", *[F.col(str(k)).alias(f"k = {k}") for k in ks], "Best_k")


def votes(best: DataFrame, gap_candidate: DataFrame | None = None) -> DataFrame:
    """(K, Votes, Criteria): each internal index has one vote, split over its best k; the gap candidate has one."""
    internal = best.where((F.col("Better") != "") & ~F.col("Index").rlike(EXTERNAL) & ~F.col("Best_k").isin("", "tie"))
    parts = internal.select(F.split("Best_k", ", ").alias("_ks")).select(F.explode(F.col("_ks").cast("array<int>")).alias("K"), (1 / F.size("_ks")).alias("v"))
    if gap_candidate is not None:
        parts = parts.unionByName(gap_candidate.select(F.col("K").cast("int").alias("K"), F.lit(1.0).alias("v")))
    return parts.groupBy("K").agg(F.sum("v").alias("Votes"), F.count(F.lit(1)).alias("Criteria"))


def suggested_k(best: DataFrame, ks: list[int], gap_candidate: DataFrame | None = None) -> DataFrame:
    """One row K: that of the best BIC if there is one, else of most votes (smaller k on ties), else the first."""
    bic = best.where((F.col("Index") == "BIC") & F.col("Best_k").isin(*[str(k) for k in ks])).select(F.col("Best_k").cast("int").alias("K"), F.lit(0).alias("rule"), F.lit(0.0).alias("v"))
    voted = votes(best, gap_candidate).where(F.col("K").isin(*ks)).select("K", F.lit(1).alias("rule"), F.col("Votes").alias("v"))
    first = best.sparkSession.range(1).select(F.lit(ks[0]).alias("K"), F.lit(2).alias("rule"), F.lit(0.0).alias("v"))
    return bic.unionByName(voted).unionByName(first).orderBy("rule", F.desc("v"), "K").limit(1).select("K")


def close_second(voted: DataFrame, k: int) -> DataFrame:
    """(K, Criteria) of solutions best on at least as many criteria as k, less one."""
    own = voted.where(F.col("K") == k).agg(F.coalesce(F.max("Criteria"), F.lit(0)).alias("_own"))
    return voted.crossJoin(F.broadcast(own)).where((F.col("K") != k) & (F.col("Criteria") >= F.col("_own") - 1)).orderBy(F.desc("Criteria"), "K").limit(1).select("K", "Criteria")


def findings(row: DataFrame) -> DataFrame:
    """(Topic, Value, Grade) of one solution's row of the comparison table."""
    value = lambda c: F.col(c).cast("double") if c in row.columns else F.lit(None).cast("double")

    def graded(v, cuts: tuple[float, ...], names: tuple[str, ...]):
        g = F.when(v > cuts[0], names[0])
        for cut, name in zip(cuts[1:], names[1:]):
            g = g.when(v > cut, name)
        return g.otherwise(names[-1])

    small = F.greatest(F.lit(5.0), 0.05 * value("N"))
    topics = [
        ("Smallest cluster", value("Minimum_N"), F.when(value("Minimum_N") < small, "small").otherwise("sufficient")),
        ("Separation", value("Silhouette"), graded(value("Silhouette"), (0.70, 0.50, 0.25), ("strong", "reasonable", "weak", "none"))),
        ("Stability", value("Bootstrap_min_Jaccard"), F.when(value("Bootstrap_min_Jaccard") >= 0.85, "high").when(value("Bootstrap_min_Jaccard") >= 0.75, "stable").when(value("Bootstrap_min_Jaccard") >= 0.60, "pattern").otherwise("unstable")),
        ("Structure beyond chance", value("Simulation_p_Silhouette"), F.when(value("Simulation_p_Silhouette") <= 0.05, "supported").otherwise("not supported")),
        ("Replication", value("Invariance"), F.when(value("Invariance") > 0.60, "replicated").otherwise("not replicated")),
        ("Classification certainty", value("Relative_entropy"), F.when(value("Relative_entropy") >= 0.80, "high").when(value("Relative_entropy") >= 0.60, "medium").otherwise("low")),
    ]
    rows = [F.struct(F.lit(t).alias("Topic"), v.alias("Value"), g.alias("Grade")) for t, v, g in topics]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("Value is not null")


def index_series(long: DataFrame) -> DataFrame:
    """(Index, K, value) for charts: finite values of indices with at least two."""
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("column"))).where("_n > 1").select("Index", "K", "value")
