"""Agreement between partitions of the same cases, and matching of their clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import squared_distance
from tessella.operators.kmeans import mean_vector


def crossed(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, x, y, n) for cases in both ``a`` and ``b(keys, id, cluster)``."""
    both = a.select(*keys, "id", F.col("cluster").alias("x")).join(b.select(*keys, "id", F.col("cluster").alias("y")), [*keys, "id"])
    return both.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _choose2(c: Column) -> Column:
    return c.cast("double") * (c.cast("double") - 1) / 2


def agreement(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, Overlap_N, ARI, Rand, VI, NMI) from a contingency table ``(keys, x, y, n)``.

    ARI is 1 if its maximum equals its expectation; NMI is 1 if neither partition divides the cases.
    """

    def by(*cols: str) -> DataFrame:
        counts = table.groupBy(*keys, *cols).agg(F.sum("n").alias("m"))
        s, h = f"s{''.join(cols)}", f"h{''.join(cols)}"
        aggs = [F.sum(_choose2(F.col("m"))).alias(s), F.sum(F.col("m") * F.log(F.col("m").cast("double"))).alias(h), F.sum("m").alias(f"n{''.join(cols)}")]
        return counts.groupBy(*keys).agg(*aggs) if keys else counts.agg(*aggs)

    x, y, xy = by("x"), by("y"), by("x", "y")
    row = x.join(y, list(keys)).join(xy, list(keys)) if keys else x.crossJoin(y).crossJoin(xy)
    n = F.col("nxy").cast("double")
    pairs = _choose2(n)
    expected = F.try_divide(F.col("sx") * F.col("sy"), pairs)
    most = (F.col("sx") + F.col("sy")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("sxy") - expected) / (most - expected))
    rand = F.try_divide(pairs + 2 * F.col("sxy") - F.col("sx") - F.col("sy"), pairs)
    entropy = lambda h: F.log(n) - F.col(h) / n
    hx, hy, hxy = entropy("hx"), entropy("hy"), entropy("hxy")
    mutual = hx + hy - hxy
    nmi = F.when((F.abs(hx) < 1e-12) & (F.abs(hy) < 1e-12), F.lit(1.0)).otherwise(F.try_divide(2 * mutual, hx + hy))
    return row.select(*keys, F.col("nxy").alias("Overlap_N"), ari.alias("ARI"), rand.alias("Rand"), F.greatest(F.lit(0.0), hx + hy - 2 * mutual).alias("VI"), nmi.alias("NMI"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Overlap_N, Coverage_A, Coverage_B, ARI, Rand, VI, NMI of two partitions ``(id, cluster)``."""
    made = agreement(crossed(a, b))
    n = a.agg(F.count(F.lit(1)).alias("_na")).crossJoin(b.agg(F.count(F.lit(1)).alias("_nb")))
    return made.crossJoin(n).select("Overlap_N", (100 * F.try_divide("Overlap_N", "_na")).alias("Coverage_A"), (100 * F.try_divide("Overlap_N", "_nb")).alias("Coverage_B"), "ARI", "Rand", "VI", "NMI")


def require_overlap(a: DataFrame, b: DataFrame) -> None:
    if a.join(b.select("id"), "id", "left_semi").limit(2).count() < 2:
        raise ValueError("the partitions share fewer than two cases")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of smallest total cost, each used once, as many as the shorter side has.
    Shortest augmenting paths; for tables of a few dozen clusters."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    rows, cols = c.shape
    u, v, owner = np.zeros(rows + 1), np.zeros(cols + 1), np.full(cols + 1, rows)
    for r in range(rows):
        owner[cols], at = r, cols
        slack, came, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols + 1, bool)
        while True:
            done[at] = True
            free = ~done[:cols]
            through = c[owner[at]] - u[owner[at]] - v[:cols]
            better = free & (through < slack)
            slack[better], came[better] = through[better], at
            nxt = int(np.flatnonzero(free)[np.argmin(slack[free])])
            step = slack[nxt]
            for j in np.flatnonzero(done):
                u[owner[j]] += step
                v[j] -= step
            slack[free] -= step
            at = nxt
            if owner[at] == rows:
                break
        while at != cols:
            owner[at] = owner[came[at]]
            at = came[at]
    pairs = [(int(owner[j]), j) for j in range(cols) if owner[j] < rows]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def kappa(table: pd.DataFrame) -> tuple[float | None, float | None]:
    """Cohen's kappa and percent agreement of a contingency table (x, y, n) after the labels of y are matched
    to those of x for most agreement; None if the numbers of clusters differ."""
    m = table.pivot_table(index="x", columns="y", values="n", aggfunc="sum", fill_value=0).to_numpy(float)
    if m.shape[0] != m.shape[1]:
        return None, None
    order = [j for _, j in assign(m.max() - m)]
    m = m[:, order]
    n = m.sum()
    seen, chance = np.trace(m) / n, float((m.sum(1) * m.sum(0)).sum()) / n**2
    return ((seen - chance) / (1 - chance) if chance < 1 else None), 100 * seen


def matched_kappa(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, Kappa, Agreement_pct) of contingency tables ``(keys, x, y, n)``, each of k x k rows."""
    names = list(keys)
    schema = ", ".join([*(f"{k} {dict(table.dtypes)[k]}" for k in names), "Kappa double", "Agreement_pct double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, pct = kappa(pdf)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in names), k, pct]], columns=[*names, "Kappa", "Agreement_pct"])

    return table.groupBy(*names).applyInPandas(run, schema)


def centroid_gaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(Cluster_A, Cluster_B, ASED) for all pairs of centres ``(cluster, center)``: mean squared difference."""
    left = a.select(F.col("cluster").alias("Cluster_A"), F.col("center").alias("_a"))
    right = b.select(F.col("cluster").alias("Cluster_B"), F.col("center").alias("_b"))
    return left.crossJoin(F.broadcast(right)).select("Cluster_A", "Cluster_B", (squared_distance(F.col("_a"), F.col("_b")) / F.size("_a")).alias("ASED"))


def match_centroids(gaps: pd.DataFrame, globally: bool = True) -> pd.DataFrame:
    """Matched rows of a k x k table of gaps: smallest total, or greedily the smallest first. A missing gap
    counts as ten times the largest plus one and is never reported as a match when greedy."""
    cost = gaps.pivot(index="Cluster_A", columns="Cluster_B", values="ASED")
    values = cost.to_numpy(float)
    known = values[np.isfinite(values)]
    values = np.where(np.isfinite(values), values, 10 * (known.max() if len(known) else 0) + 1)
    if globally:
        chosen = assign(values)
    else:
        chosen, left = [], values.copy()
        for _ in range(min(left.shape)):
            i, j = np.unravel_index(np.argmin(left), left.shape)
            chosen.append((int(i), int(j)))
            left[i, :] = np.inf
            left[:, j] = np.inf
    return pd.DataFrame([(cost.index[i], cost.columns[j], cost.to_numpy()[i, j]) for i, j in chosen], columns=["Cluster_A", "Cluster_B", "ASED"])


def compare_centroids(a: DataFrame, b: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Two solutions ``(cluster, variables)`` by their centres on shared variables, standardised by the mean and
    SD of A (SD 0 counts as 1): Cluster_A, N_A, Cluster_B, N_B, ASED, then clusters left over."""
    stats = a.agg(*[F.avg(v).alias(f"m_{v}") for v in variables], *[F.stddev_samp(v).alias(f"s_{v}") for v in variables]).first()
    z = lambda df: df.select("cluster", F.array(*[(F.col(v) - stats[f"m_{v}"]) / (stats[f"s_{v}"] or 1.0) for v in variables]).alias("x"))
    ca, cb = (z(df).groupBy("cluster").agg(mean_vector("x", len(variables)).alias("center"), F.count(F.lit(1)).alias("N")) for df in (a, b))
    matched = a.sparkSession.createDataFrame(match_centroids(centroid_gaps(ca, cb).toPandas()))
    na, nb = ca.select(F.col("cluster").alias("Cluster_A"), F.col("N").alias("N_A")), cb.select(F.col("cluster").alias("Cluster_B"), F.col("N").alias("N_B"))
    met = matched.join(na, "Cluster_A").join(nb, "Cluster_B").select("Cluster_A", "N_A", "Cluster_B", "N_B", "ASED")
    return met.unionByName(na.join(matched, "Cluster_A", "left_anti"), allowMissingColumns=True).unionByName(nb.join(matched, "Cluster_B", "left_anti"), allowMissingColumns=True)


def unmatched(a: DataFrame, b: DataFrame, matched: DataFrame) -> DataFrame:
    """Side and Cluster of what ``matched(Cluster_A, Cluster_B)`` leaves over."""
    left = a.select(F.col("cluster").alias("Cluster_A")).distinct().join(matched, "Cluster_A", "left_anti").select(F.lit("A").alias("Side"), F.col("Cluster_A").alias("Cluster"))
    right = b.select(F.col("cluster").alias("Cluster_B")).distinct().join(matched, "Cluster_B", "left_anti").select(F.lit("B").alias("Side"), F.col("Cluster_B").alias("Cluster"))
    return left.unionByName(right)
