"""Methods that need all distances of a set, on the representatives of each key: one bounded matrix per key and task.

A key (a replicate, an imputation, a half, or nothing) has at most ``MAX_REPRESENTATIVES`` representatives: the
cases themselves while they are few, otherwise micro-clusters that carry their numbers of cases. Under Euclidean
distance those are k-means clusters at their means; under any other, cases drawn by hash, every case being
counted with the nearest. So all keys are clustered in one job, one task each, and memory follows from the bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import matrices
from tessella.functions.hashing import key_hash
from tessella.operators import kmeans, linkage
from tessella.session import materialize

#: Cases that are compared with the representatives of their key at a time.
BLOCK_CASES = 4000


def place_cases(cases: DataFrame, name: str, count: int, weights: list[float] | None = None, ranges: list[float] | None = None, keys: tuple[str, ...] = (), seed: int = 2026, euclidean: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases(keys, id, x, rep), representatives(keys, rep, x, n)), at most ``count`` for a key.

    ``rep`` numbers the representatives of a key in order of their first case. With ``euclidean`` they are k-means
    micro-clusters, else sampled medoids: ``count`` cases of smallest hash, and each case goes to the nearest, the
    smaller id on ties.
    """
    if count > linkage.MAX_REPRESENTATIVES:
        raise ValueError(f"at most {linkage.MAX_REPRESENTATIVES} representatives")
    rows = cases.select(*keys, "id", "x")
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= count:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("id")) if keys else F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))
        own = materialize(rows.withColumn("rep", number.cast("bigint")))
        return own, own.select(*keys, "rep", "x", F.lit(1.0).alias("n"))
    if euclidean:
        fitted = materialize(kmeans.kmeans(rows, count, 1, 5, seed, keys=keys))
        reps = kmeans.centroids(fitted, kmeans.dimensions(rows), keys).select(*keys, F.col("cluster").cast("bigint").alias("rep"), F.col("center").alias("x"), F.col("n").cast("double").alias("n"))
        return fitted.select(*keys, "id", "x", F.col("cluster").cast("bigint").alias("rep")), materialize(reps)
    return _sampled_medoids(rows, name, count, most, weights, ranges, keys, seed)


def _sampled_medoids(rows: DataFrame, name: str, count: int, most: int, weights, ranges, keys: tuple[str, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    drawn = key_hash(str(seed), "medoid", *[F.col(c) for c in keys], F.col("id"))
    # Only cases of a small hash can be among the smallest: the ranking is not over all cases.
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else rows.agg(F.count(F.lit(1)).alias("_n"))
    met = (rows.join(sizes, list(keys)) if keys else rows.crossJoin(F.broadcast(sizes))).withColumn("_u", drawn)
    likely = met.where(F.col("_u") / float(2**60) * F.col("_n") <= count + 10 * math.sqrt(count) + 50)
    first = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    chosen = likely.withColumn("_r", F.row_number().over(first.orderBy("_u", "id"))).where(F.col("_r") <= count)
    chosen = materialize(chosen.withColumn("rep", F.row_number().over(first.orderBy("id")).cast("bigint")).select(*keys, "rep", "id", "x"))
    blocks = max(1, math.ceil(most / BLOCK_CASES))
    left = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    right = chosen.select(*[F.col(c).alias(f"{c}2") for c in keys], "rep", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b2"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = a[[*keys, "id", "x"]].copy()
        if not len(a) or not len(b):
            return out.assign(rep=0).iloc[:0]
        b = b.sort_values("rep")
        x, y, reps, made = matrices.points(a["x"]), matrices.points(b["y"]), b["rep"].to_numpy(), []
        for i in range(0, len(a), 1000):
            d = matrices.matrix(name, x[i : i + 1000], y, weights, ranges)
            made.append(reps[np.argmin(np.where(np.isnan(d), np.inf, d), 1)])
        return out.assign(rep=np.concatenate(made))

    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys) + f"id {kinds['id']}, x array<double>, rep bigint"
    placed = materialize(left.groupBy(*keys, "_b").cogroup(right.groupBy(*[f"{c}2" for c in keys], "_b2")).applyInPandas(nearest, schema))
    n = placed.groupBy(*keys, "rep").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return placed, materialize(chosen.join(n, [*keys, "rep"]).select(*keys, "rep", "x", "n"))


def relocated(x: np.ndarray, w: np.ndarray, label: np.ndarray, rounds: int) -> np.ndarray:
    """Weighted points moved one by one, in order, while that lowers the within-cluster sum of squares."""
    names, at = np.unique(label, return_inverse=True)
    at, size = at.copy(), np.bincount(at, w)
    sums = np.stack([np.bincount(at, w * x[:, j]) for j in range(x.shape[1])], 1)
    members = np.bincount(at)
    for _ in range(rounds):
        moved = False
        for i in range(len(x)):
            a = at[i]
            if members[a] <= 1:
                continue
            d2 = ((sums / size[:, None] - x[i]) ** 2).sum(1)
            cost = size * w[i] / (size + w[i]) * d2 - size[a] * w[i] / max(size[a] - w[i], 1e-12) * d2[a]
            cost[a] = np.inf
            b = int(np.argmin(cost))
            if cost[b] < -1e-10:
                at[i], moved = b, True
                members[a] -= 1
                members[b] += 1
                size[a], size[b] = size[a] - w[i], size[b] + w[i]
                sums[a] -= w[i] * x[i]
                sums[b] += w[i] * x[i]
        if not moved:
            break
    return at


def settled(x: np.ndarray, w: np.ndarray, label: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd rounds of weighted points from the means of a partition, until nothing moves."""
    _, at = np.unique(label, return_inverse=True)
    for _ in range(rounds):
        size = np.maximum(np.bincount(at, w), 1e-300)
        centres = np.stack([np.bincount(at, w * x[:, j], len(size)) / size for j in range(x.shape[1])], 1)
        new = matrices.matrix("sqeuclidean", x, centres).argmin(1)
        if (new == at).all() or len(np.unique(new)) < len(size):
            break
        at = new
    return at


def swapped(d: np.ndarray, w: np.ndarray, k: int, start: list[int] | None = None, rounds: int = 1000) -> tuple[np.ndarray, list[int]]:
    """Labels and medoids of weighted points: BUILD, then the best swap as long as one helps; ties to the first."""
    chosen = list(start or [])
    for _ in range(k - len(chosen)):
        now = d[:, chosen].min(1) if chosen else None
        gain = w @ d if now is None else -(w @ np.maximum(now[:, None] - d, 0))
        gain[chosen] = np.inf
        chosen.append(int(np.argmin(gain)))
    for _ in range(rounds):
        order = np.argsort(d[:, chosen], axis=1, kind="stable")
        own = order[:, 0]
        d1 = d[np.arange(len(d)), np.asarray(chosen)[own]]
        d2 = d[np.arange(len(d)), np.asarray(chosen)[order[:, 1]]] if len(chosen) > 1 else np.full(len(d), np.inf)
        others = np.minimum(d - d1[:, None], 0) * w[:, None]
        mine = (np.minimum(d, d2[:, None]) - d1[:, None]) * w[:, None] - others
        change = np.stack([mine[own == m].sum(0) for m in range(len(chosen))], 1) + others.sum(0)[:, None]
        change[chosen] = np.inf
        c, m = divmod(int(np.argmin(change)), len(chosen))
        if change[c, m] >= -1e-12:
            break
        chosen[m] = c
    chosen.sort()
    return np.argmin(d[:, chosen], 1), chosen


def fuzzy_shares(d: np.ndarray, w: np.ndarray, k: int, rounds: int, tolerance: float = 1e-9) -> np.ndarray | None:
    """Memberships of weighted points on unsquared distances, exponent 2, from k far-apart points; None if k is above
    n / 2 - 1."""
    if k > w.sum() / 2 - 1:
        return None
    far = [int(np.argmin(w @ d))]
    while len(far) < k:
        reach = d[:, far].min(1)
        reach[far] = -1
        far.append(int(np.argmax(reach)))
    u = 1 / (d[:, far] + 1e-3)
    u /= u.sum(1, keepdims=True)
    before = math.inf
    for _ in range(rounds):
        q = u * u * w[:, None]
        s, pull = q.sum(0), d @ q
        spread = (q * pull).sum(0)
        now = float((spread / (2 * s)).sum())
        if abs(before - now) <= tolerance * max(abs(now), 1.0):
            break
        before = now
        u = 1 / np.maximum(pull / s - spread / (2 * s * s), 1e-12)
        u /= u.sum(1, keepdims=True)
    return u


def start_labels(x: np.ndarray, w: np.ndarray, d: np.ndarray, method: str, ks: list[int], beta: float) -> dict[int, np.ndarray]:
    """Cuts of a hierarchy of weighted points for each k. Ward, centroid and median linkage start from coordinates."""
    if method == "diana":
        return linkage.diana(d, w, ks)
    own = linkage.initial_distances(x, w, method) if method in ("ward.D", *linkage.SQUARED) else d
    merges = linkage.lance_williams(own, w, method, beta)
    return {k: linkage.cut_merges(len(x), merges, k) for k in ks}


def within_ss(x: np.ndarray, w: np.ndarray, label: np.ndarray) -> float:
    """Within-cluster sum of squares of weighted points."""
    total = 0.0
    for g in np.unique(label):
        mine, mass = x[label == g], w[label == g]
        total += float((mass[:, None] * (mine - (mass @ mine) / mass.sum()) ** 2).sum())
    return total


def labeller(method: str, ks: list[int], beta: float, hybrid_start: str, max_iter: int, algorithm: str = "Lloyd") -> Callable[..., dict[int, np.ndarray]]:
    """The kernel of a method: from weighted points and their distances to labels for each k. A k without a solution
    is left out. The objective of the partition that a hybrid starts from is put into ``starts``, by k."""

    def run(x: np.ndarray, w: np.ndarray, d: np.ndarray, starts: dict[int, float] | None = None) -> dict[int, np.ndarray]:
        starts = {} if starts is None else starts
        able = [k for k in ks if k <= len(x)]
        if not able:
            return {}
        if method == "pam":
            return {k: swapped(d, w, k)[0] for k in able}
        if method == "fuzzy":
            found = {k: fuzzy_shares(d, w, k, max_iter) for k in able}
            return {k: np.argmax(np.round(u, 12), 1) for k, u in found.items() if u is not None}
        tree = method if method in linkage.TREES else "ward.D2" if method == "ward_relocate" else hybrid_start
        start = start_labels(x, w, d, tree, able, beta)
        if tree != method and method != "hybrid_pam":
            starts |= {k: within_ss(x, w, label) for k, label in start.items()}
        if method in ("ward_relocate", "hybrid_relocate"):
            return {k: relocated(x, w, label, max_iter) for k, label in start.items()}
        if method == "hybrid_kmeans":
            made = {k: settled(x, w, label, max_iter) for k, label in start.items()}
            return {k: relocated(x, w, label, max_iter) for k, label in made.items()} if algorithm == "Hartigan-Wong" else made
        if method == "hybrid_pam":
            out = {}
            for k, label in start.items():
                first = [int(m[np.argmin(d[np.ix_(m, m)] @ w[m])]) for g in np.unique(label) if len(m := np.flatnonzero(label == g))]
                starts[k] = float(w @ d[:, first].min(1))
                out[k] = swapped(d, w, k, first)[0]
            return out
        return start

    return run


def grouped_fit(cases: DataFrame, method: str, ks: list[int], name: str = "euclidean", count: int = 2000, weights: list[float] | None = None, ranges: list[float] | None = None, keys: tuple[str, ...] = (), beta: float = -0.25, hybrid_start: str = "ward.D2", max_iter: int = 100, seed: int = 2026, algorithm: str = "Lloyd", starts: bool = False) -> DataFrame:
    """(keys, k, id, cluster) of every key of ``cases(keys, id, x)`` and each k, clusters numbered by their first case.

    A key for which a k has no solution of k clusters has no rows for it. Exact for keys of up to ``count`` cases. With ``starts``
    there is a column start: the objective of the partition that a hybrid started from.
    """
    euclidean = name in ("euclidean", "minkowski", "mahalanobis", "sqeuclidean")
    placed, reps = place_cases(cases, name, count, weights, ranges, keys, seed, euclidean)
    kernel = labeller(method, ks, beta, hybrid_start, max_iter, algorithm)
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x, w = matrices.points(pdf["x"]), pdf["n"].to_numpy(float)
        with np.errstate(invalid="ignore"):
            begun: dict[int, float] = {}
            made = kernel(x, w, matrices.square(name, x, weights, ranges), begun)
        parts = [pdf[[*names, "rep"]].assign(k=k, g=label, start=begun.get(k, np.nan)) for k, label in made.items() if len(np.unique(label)) == k]
        return pd.concat(parts) if parts else pdf[[*names, "rep"]].assign(k=0, g=0, start=np.nan).iloc[:0]

    kinds = dict(cases.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in names) + "rep bigint, k int, g bigint, start double"
    grouped = reps.groupBy(*names) if names else reps.withColumn("_all", F.lit(1)).groupBy("_all")
    labels = materialize(grouped.applyInPandas(run, schema))
    met = placed.select(*names, "id", "rep").join(labels, [*names, "rep"])
    first = met.groupBy(*names, "k", "g").agg(F.min("id").alias("_first"))
    numbers = first.withColumn("cluster", F.row_number().over(Window.partitionBy(*names, "k").orderBy("_first"))).drop("_first")
    more = [F.nanvl("start", F.lit(None).cast("double")).alias("start")] if starts else []
    return met.join(numbers, [*names, "k", "g"]).select(*names, "k", "id", F.col("cluster").cast("int").alias("cluster"), *more)


def grouped_tree(cases: DataFrame, method: str, name: str = "euclidean", count: int = 2000, weights: list[float] | None = None, ranges: list[float] | None = None, beta: float = -0.25, seed: int = 2026) -> DataFrame:
    """(stage, a, b, height, n) merges of one hierarchy of ``cases(id, x)`` or their representatives, named by their first
    case; n counts the representatives of the merged group. DIANA's splits are given in reverse, with the diameter of
    the group that is split as height."""
    euclidean = name in ("euclidean", "minkowski", "mahalanobis", "sqeuclidean")
    placed, reps = place_cases(cases, name, count, weights, ranges, (), seed, euclidean)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x, w, rep = matrices.points(pdf["x"]), pdf["n"].to_numpy(float), pdf["rep"].to_numpy()
        with np.errstate(invalid="ignore"):
            d = matrices.square(name, x, weights, ranges)
            if method == "diana":
                made = linkage.diana_merges(d, w)
            else:
                made = linkage.lance_williams(linkage.initial_distances(x, w, method) if method in ("ward.D", *linkage.SQUARED) else d, w, method, beta)
        size, out = np.ones(len(x), np.int64), []
        for stage, (a, b, h) in enumerate(made):
            size[a] += size[b]
            out.append((stage + 1, rep[a], rep[b], h, size[a]))
        return pd.DataFrame(out, columns=["stage", "a", "b", "height", "n"])

    tree = materialize(reps.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "stage bigint, a bigint, b bigint, height double, n bigint"))
    first = materialize(placed.groupBy("rep").agg(F.min("id").alias("first")))
    named = lambda c: first.select(F.col("rep").alias(c), F.col("first").alias(f"_{c}"))
    return tree.join(F.broadcast(named("a")), "a").join(F.broadcast(named("b")), "b").select("stage", F.col("_a").alias("a"), F.col("_b").alias("b"), "height", "n")
