"""Refitting a configured method on every key of a table at once: replicates, halves, imputations, reference sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import ClusterConfig
from tessella.functions import distance
from tessella.operators import groups, kmeans, mixture
from tessella.session import materialize

#: From cases(keys, id, x), k and the keys to (keys, id, cluster, x): only of keys with a solution of k clusters. One with
#: the attribute ``takes_copies`` also takes a column n, the number of times that a case counts, and hands it on.
Refit = Callable[[DataFrame, int, tuple[str, ...]], DataFrame]


def whole(fitted: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """Of ``fitted(keys, cluster, ...)`` the keys that have k clusters."""
    fitted = materialize(fitted)
    good = fitted.select(*keys, "cluster").distinct().groupBy(*keys).count().where(F.col("count") == k).select(*keys)
    return fitted.join(F.broadcast(good), list(keys), "left_semi") if keys else fitted


def of_kmeans(nstart: int = 5, rounds: int = 30, seed: int = 2026) -> Refit:
    def run(cases: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
        copies = "n" if "n" in cases.columns else None
        return whole(kmeans.kmeans(cases, k, nstart, rounds, seed, keys=keys, copies=copies), k, keys)

    run.takes_copies = True
    return run


def of_method(config: ClusterConfig, ranges: list[float] | None = None, nstart: int = 5, rounds: int | None = None) -> Refit:
    """The refit of the configured method and distance. ``ranges`` are those of Gower distance.

    Methods that need all distances work on at most ``config.representatives`` points of a key (see ``operators.groups``):
    exactly, if a key has no more cases.
    """
    rounds = rounds or config.max_iter
    if config.method == "kmeans":
        return of_kmeans(nstart, min(rounds, 30), config.seed)
    name = "euclidean" if config.distance == "mahalanobis" else config.distance
    weights = list(config.weight()) if name in ("gower", *distance.BINARY) else None

    def run(cases: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
        rows = cases.select(*keys, "id", "x")
        if config.method == "gmm":
            used = keys or ("_one",)
            made = mixture.gmm_keys(rows if keys else rows.withColumn("_one", F.lit(1)), k, used, config.covariance, rounds, config.seed).select(*keys, "id", "x", "cluster")
        else:
            made = groups.grouped_fit(rows, config.method, [k], name, config.representatives, weights, ranges, keys, config.beta, config.hybrid_start, rounds, config.seed, config.hybrid_algorithm)
            made = made.drop("k").join(rows, [*keys, "id"])
        return whole(made.select(*keys, "id", "cluster", "x"), k, keys)

    return run
