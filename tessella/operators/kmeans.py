"""Centroid methods: k-means from many starts at once, seeding, refinement, relocation.

Every job carries optional key columns (``keys``), e.g. replicate or imputation, and clusters each key's cases on
their own in the same rounds. Centres are tables keyed (keys, start, cluster): k rows per start. Rows
meet them by a join on the keys, or, without keys, by a cross join with k rows; sums per cluster are
partial aggregations, so a round shuffles only as many rows as there are centres per task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import key_uniform
from tessella.functions.vectors import squared_distance
from tessella.operators.centre_passes import MANY_CENTRES, CentrePasses, Relocation, placed, plus_plus
from tessella.session import materialize

#: Centres are sent to all tasks up to this many numbers (rows times dimensions).
BROADCAST_NUMBERS = 2_000_000
#: A centre that moves by less than the root of this has come to rest; sums in another order differ by as much.
STILL = 1e-18


def _few(centres: DataFrame) -> bool:
    """Whether the driver may hold the centres: their number is counted, and they have a known width."""
    row = centres.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("center")).alias("p")).first()
    return row["n"] * (row["p"] or 0) <= BROADCAST_NUMBERS


def nearest(cases: DataFrame, centres: DataFrame, keys: tuple[str, ...] = (), starts: bool = False) -> DataFrame:
    """``cases`` with cluster and d2: the nearest of ``centres(keys, cluster, center)`` by squared Euclidean
    distance, the lower cluster on ties. Stateless, so ``cases`` may be a stream (without ``starts``).

    The centres of a key are gathered into one array, so a case meets its key's centres in one row.
    """
    by = (*keys, "start") if starts else keys
    packed = centres.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("_centres"))
    met = cases.join(packed, list(keys)) if keys else cases.crossJoin(F.broadcast(packed))
    best = F.array_min(F.transform("_centres", lambda c: F.struct(squared_distance(F.col("x"), c["center"]).alias("d2"), c["cluster"].alias("cluster"))))
    return met.withColumn("_best", best).withColumns({"cluster": F.col("_best.cluster"), "d2": F.col("_best.d2")}).drop("_best", "_centres")


def mean_vector(x: str, size: int) -> Column:
    return F.array(*[F.avg(F.col(x)[j]) for j in range(size)])


def centroids(assigned: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cluster, center, n) of ``assigned(keys, cluster, x)``."""
    return assigned.groupBy(*keys, "cluster").agg(mean_vector("x", size).alias("center"), F.count(F.lit(1)).alias("n"))


def dimensions(cases: DataFrame) -> int:
    row = cases.select(F.size("x").alias("p")).first()
    return row["p"] if row else 0


def lloyd(cases: DataFrame, centres: DataFrame, rounds: int, keys: tuple[str, ...] = (), starts: bool = False, size: int | None = None) -> DataFrame:
    """Centres after ``rounds`` of Lloyd's algorithm, fewer if no centre moves any more. A cluster that loses its
    cases keeps its centre. The driver holds the centres, k rows per start, up to ``BROADCAST_NUMBERS`` numbers."""
    by = (*keys, "start") if starts else keys
    size = size or dimensions(cases)
    if _few(centres):
        passes = CentrePasses(cases, centres, keys, by, size)
        passes.settle(rounds, STILL)
        return passes.table()
    return _lloyd_by_joins(cases, centres, rounds, keys, starts, size)


def _lloyd_by_joins(cases: DataFrame, centres: DataFrame, rounds: int, keys: tuple[str, ...], starts: bool, size: int) -> DataFrame:
    """``lloyd`` for more centres than the driver should hold. Every round writes its centres."""
    by = (*keys, "start") if starts else keys
    for _ in range(rounds):
        assigned = nearest(cases, centres, keys, starts)
        means = assigned.groupBy(*by, "cluster").agg(mean_vector("x", size).alias("_new"))
        moved = squared_distance(F.col("_new"), F.col("center")) > STILL
        centres = centres.select(*by, "cluster", "center").join(means, [*by, "cluster"], "left").select(*by, "cluster", F.coalesce("_new", "center").alias("center"), F.coalesce(moved, F.lit(False)).alias("_moved"))
        written = materialize(centres)
        centres = written.drop("_moved")
        if written.where("_moved").isEmpty():
            break
    return centres


def within_ss(assigned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return assigned.groupBy(*by).agg(F.sum("d2").alias("ss"), F.count_distinct("cluster").alias("clusters"))


def random_seeds(cases: DataFrame, k: int, starts: int, seed: int, keys: tuple[str, ...] = (), copies: str | None = None) -> DataFrame:
    """(keys, start, cluster, center): k cases per start, by smallest hash; a map-side top k per start.

    A case enters the ranking of a start only if its hash is small enough for k of the cases to do so
    with near certainty, so that the ranking is not over all cases. Cases with ``copies``, small numbers, are as much likelier
    to be drawn, each once.
    """
    n = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else cases.agg(F.count(F.lit(1)).alias("_n"))
    met = cases.join(n, list(keys)) if keys else cases.crossJoin(F.broadcast(n))
    drawn = met.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts)))).withColumn("_u", key_uniform(str(seed), *[F.col(c) for c in keys], F.col("start"), F.col("id")))
    if copies:  # the smallest of so many uniform numbers
        drawn = drawn.withColumn("_u", 1 - F.pow(1 - F.col("_u"), 1.0 / F.col(copies)))
    likely = drawn.where(F.col("_u") * F.col("_n") <= 20 * k + 60)
    first = Window.partitionBy(*keys, "start").orderBy("_u", "id")
    return likely.withColumn("cluster", F.row_number().over(first)).where(F.col("cluster") <= k).select(*keys, "start", "cluster", F.col("x").alias("center"))


def plus_plus_seeds(cases: DataFrame, k: int, starts: int, seed: int, keys: tuple[str, ...] = (), copies: str | None = None) -> DataFrame:
    """k-means++: each next centre drawn with probability proportional to the squared distance to the
    nearest so far (uniform if all are zero). One pass per centre, all starts together: the draw is the case of
    smallest -ln(u) / d2. The driver holds the centres up to ``BROADCAST_NUMBERS`` numbers; beyond, rounds are joins."""
    size = dimensions(cases)
    groups = cases.select(*keys).distinct().limit(BROADCAST_NUMBERS).count() if keys else 1
    if groups * starts * k * size <= BROADCAST_NUMBERS:
        return plus_plus(cases, k, starts, seed, keys, size, copies)
    return _plus_plus_by_joins(repeated(cases, copies), k, starts, seed, keys)


def _plus_plus_by_joins(cases: DataFrame, k: int, starts: int, seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``plus_plus_seeds`` for more centres than the driver should hold: an aggregation per centre."""
    by = [*keys, "start"]
    every = cases.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts))))
    made: DataFrame | None = None
    for c in range(1, k + 1):
        u = F.greatest(key_uniform(str(seed), str(c), *[F.col(x) for x in keys], F.col("start"), F.col("id")), F.lit(1e-300))
        if made is None:
            weight = F.lit(1.0)
            pool = every
        else:
            near = nearest(cases.select(*keys, "id", "x"), made, keys, starts=True)
            pool, weight = near, F.col("d2")
        score = F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(1e300) * (1 + u))
        pick = pool.groupBy(*by).agg(F.min_by(F.col("x"), F.struct(score, F.col("id"))).alias("center"))
        new = pick.select(*by, F.lit(c).alias("cluster"), "center")
        made = materialize(new if made is None else made.unionByName(new))
    return made


def repeated(cases: DataFrame, copies: str | None) -> DataFrame:
    """A row for each of the ``copies`` of a case, as the rounds by joins take them. A case's own copies are few."""
    return cases if copies is None else cases.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies).cast("bigint")))).drop("_copy")


def kmeans(cases: DataFrame, k: int, nstart: int = 20, rounds: int = 20, seed: int = 2026, keys: tuple[str, ...] = (), extra: DataFrame | None = None, plus_plus: int = 0, copies: str | None = None) -> DataFrame:
    """(keys, id, cluster, d2): the best of all starts by within-cluster sum of squares.

    ``extra(keys, start, cluster, center)`` adds starts of the caller's, e.g. from a hierarchy; their numbers are
    below 1. Solutions with fewer than k clusters are taken only if no start gives k. ``copies`` is a column with the
    number of times that a case counts.
    """
    seeds = random_seeds(cases, k, nstart, seed, keys, copies)
    if plus_plus:
        seeds = seeds.unionByName(plus_plus_seeds(cases, k, plus_plus, seed + 1, keys, copies).withColumn("start", F.col("start") + nstart))
    if extra is not None:
        seeds = seeds.unionByName(extra.select(*seeds.columns))
    seeds = materialize(seeds)
    if _few(seeds):
        passes = CentrePasses(cases, seeds, keys, (*keys, "start"), dimensions(cases), copies)
        passes.settle(rounds, STILL)
        passes.best()
        if not keys and passes.width >= MANY_CENTRES:  # written, as it is read more than once
            return renumbered(materialize(placed(cases, passes.values[0, : len(passes.labels[0])], passes.labels[0])))
        return renumbered(nearest(cases, passes.table().drop("start"), keys), keys)
    every = repeated(cases, copies)
    centres = _lloyd_by_joins(every, seeds, rounds, keys, True, dimensions(cases))
    scored = within_ss(nearest(every, centres, keys, starts=True), (*keys, "start"))
    order = F.struct(-F.col("clusters"), F.col("ss"), F.col("start"))
    best = scored.groupBy(*keys).agg(F.min_by("start", order).alias("start")) if keys else scored.agg(F.min_by("start", order).alias("start"))
    chosen = centres.join(F.broadcast(best) if not keys else best, [*keys, "start"]).drop("start")
    return renumbered(nearest(cases, materialize(chosen), keys), keys)


def renumbered(assigned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Clusters numbered 1..k by their smallest case id."""
    first = assigned.groupBy(*keys, "cluster").agg(F.min("id").alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_first") if keys else Window.orderBy("_first")
    numbers = first.withColumn("_number", F.row_number().over(order)).drop("_first")
    return assigned.join(F.broadcast(numbers) if not keys else numbers, [*keys, "cluster"]).withColumn("cluster", F.col("_number")).drop("_number")


def partition_ss(assigned: DataFrame, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Within-cluster sum of squares from sums alone: sum of squares less |cluster sum|^2 / n."""
    sums = assigned.groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[j]) for j in range(size)]).alias("s"),
        F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("q"),
    )
    ss = F.col("q") - F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v) / F.col("n")
    return sums.groupBy(*by).agg(F.sum(ss).alias("ss")) if by else sums.agg(F.sum(ss).alias("ss"))


def relocate(assigned: DataFrame, max_iter: int = 50, tolerance: float = 1e-10) -> tuple[DataFrame, list[dict]]:
    """Moves cases between clusters while that lowers the within-cluster sum of squares.

    A case of cluster a gains by going to b if n_b d_b / (n_b + 1) - n_a d_a / (n_a - 1) < -tolerance (d: squared distance to
    the centre). Each round scores all cases against all centres and moves every gaining case; if the
    sum of squares does not fall, only the best move of disjoint pairs of clusters is made, whose gains
    add up. No cluster is emptied. A round is one pass; the driver holds the centres. Returns the partition and a trace of
    (Iteration, Moved, Within_SS).
    """
    size = dimensions(assigned)
    state = materialize(assigned.select("id", "x", "cluster"))
    ss = partition_ss(state, size).first()["ss"]
    rows = [(r["cluster"], r["n"], r["center"]) for r in centroids(state, size).orderBy("cluster").collect()]
    passes = Relocation(state, rows, tolerance)
    trace: list[dict] = []
    for i in range(max_iter):
        n, sums, squares, out, best = passes.score()
        if not best:
            break
        new_ss = float((squares - (sums * sums).sum(1) / np.maximum(n, 1)).sum())
        if (out < passes.n).all() and new_ss < ss - tolerance:
            moved = int(out.sum())
            passes.take_all(n, sums)
        else:
            used: set[int] = set()
            chosen = []
            for move in best:
                if not used & {move[2], move[3]}:
                    used |= {move[2], move[3]}
                    chosen.append(move)
            moved, new_ss = len(chosen), ss + sum(m[0] for m in chosen)
            passes.take(chosen)
        trace.append({"Iteration": i + 1, "Moved": moved, "Within_SS": new_ss})
        ss = new_ss
    return passes.table(), trace


def medoids_of(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """(cluster, id): the member with the smallest sum of distances to its cluster, from pairs(i, j, d)."""
    both = pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    own = both.join(partition.select(F.col("id").alias("i"), F.col("cluster")), "i").join(partition.select(F.col("id").alias("j"), F.col("cluster").alias("_cj")), "j").where("cluster = _cj")
    sums = partition.select("cluster", "id").join(own.groupBy(F.col("i").alias("id")).agg(F.sum("d").alias("s")), "id", "left")
    return sums.groupBy("cluster").agg(F.min_by("id", F.struct(F.coalesce("s", F.lit(0.0)), F.col("id"))).alias("id"))
