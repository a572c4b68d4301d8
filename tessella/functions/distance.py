"""The distances between two cases, as expressions on ``array<double>`` columns.

Every function takes the two arrays and gives a column, so the same expression serves all pairs of a
block, rows against a few centres, or a stream of rows. Null components (Gower only) are missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import average_ranks, centred, dot, pairwise, squared_distance, total, weighted

BINARY = ("jaccard", "simple_matching", "russell_rao")
COUNT = ("chi_square", "phi_square")


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(squared_distance(x, y))


def manhattan(x: Column, y: Column) -> Column:
    return total(pairwise(lambda a, b: F.abs(a - b), x, y))


def maximum(x: Column, y: Column) -> Column:
    return F.array_max(pairwise(lambda a, b: F.abs(a - b), x, y))


def cosine(x: Column, y: Column) -> Column:
    similarity = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - similarity))


def correlation(x: Column, y: Column) -> Column:
    return cosine(centred(x), centred(y))


def spearman(x: Column, y: Column) -> Column:
    return correlation(average_ranks(x), average_ranks(y))


def gower(x: Column, y: Column, ranges: list[float], weights: list[float] | None = None) -> Column:
    """Weighted mean of |difference| / range over the components known in both; null if there are none.
    Binary components have range 1 and ordered ones are level codes."""
    weights = weights or [1.0] * len(ranges)
    scale = F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranges, weights)])
    both = F.zip_with(pairwise(lambda a, b: F.abs(a - b), x, y), scale, lambda d, s: F.struct(d.alias("d"), s["r"].alias("r"), s["w"].alias("w")))
    known = F.filter(both, lambda t: t["d"].isNotNull())
    return F.try_divide(total(F.transform(known, lambda t: t["w"] * t["d"] / t["r"])), total(F.transform(known, lambda t: t["w"])))


def jaccard(x: Column, y: Column, weights: list[float] | None = None) -> Column:
    both = weighted(pairwise(lambda a, b: a * b, x, y), weights)
    union = weighted(pairwise(lambda a, b: F.greatest(a, b), x, y), weights)
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - both / union)


def simple_matching(x: Column, y: Column, weights: list[float] | None = None) -> Column:
    all_weight = F.size(x).cast("double") if weights is None else F.lit(float(sum(weights)))
    return weighted(pairwise(lambda a, b: F.abs(a - b), x, y), weights) / all_weight


def russell_rao(x: Column, y: Column, weights: list[float] | None = None) -> Column:
    """Distance of a case to itself is 0 by definition; callers leave such pairs out."""
    all_weight = F.size(x).cast("double") if weights is None else F.lit(float(sum(weights)))
    return 1 - weighted(pairwise(lambda a, b: a * b, x, y), weights) / all_weight


def chi_square(x: Column, y: Column) -> Column:
    """Of the 2 x p table of two count profiles."""
    rows = (total(x), total(y))
    everything = rows[0] + rows[1]
    cells = F.filter(pairwise(lambda a, b: F.struct(a.alias("a"), b.alias("b")), x, y), lambda t: t["a"] + t["b"] > 0)
    parts = total(F.transform(cells, lambda t: t["a"] * t["a"] / ((t["a"] + t["b"]) * rows[0]) + t["b"] * t["b"] / ((t["a"] + t["b"]) * rows[1])))
    return F.sqrt(F.greatest(F.lit(0.0), everything * (parts - 1)))


def phi_square(x: Column, y: Column) -> Column:
    return F.sqrt(F.pow(chi_square(x, y), 2) / (total(x) + total(y)))


def distance(name: str, x: Column, y: Column, weights: list[float] | None = None, ranges: list[float] | None = None) -> Column:
    plain = {
        "euclidean": euclidean,
        "sqeuclidean": squared_distance,
        "minkowski": euclidean,
        "manhattan": manhattan,
        "maximum": maximum,
        "correlation": correlation,
        "cosine": cosine,
        "spearman": spearman,
        "chi_square": chi_square,
        "phi_square": phi_square,
    }
    if name in plain:
        return plain[name](x, y)
    if name in BINARY:
        return {"jaccard": jaccard, "simple_matching": simple_matching, "russell_rao": russell_rao}[name](x, y, weights)
    if name == "gower":
        if ranges is None:
            raise ValueError("Gower distance needs the variables' ranges")
        return gower(x, y, ranges, weights)
    raise ValueError(f"unknown distance {name!r}")


def whiten(df: DataFrame, variables: list[str], out: str = "x") -> DataFrame:
    """Mahalanobis: adds ``out``, in which Euclidean distance is Mahalanobis distance of ``variables``."""
    p = len(variables)
    aggs = [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(variables) for j, b in enumerate(variables) if i <= j]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    if row["n"] <= p + 1:
        raise ValueError("Mahalanobis distance needs more cases than variables + 1")
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    values, vectors = np.linalg.eigh(cov)
    if values.min() < 1e-10:
        raise ValueError("the covariance matrix is singular: drop a redundant variable")
    root = vectors / np.sqrt(values)
    parts = [sum((F.col(v) * float(root[i, j]) for i, v in enumerate(variables)), F.lit(0.0)) for j in range(p)]
    return df.withColumn(out, F.array(*parts))


def whiten_keys(df: DataFrame, variables: list[str], keys: tuple[str, ...], out: str = "x") -> DataFrame:
    """``whiten`` of each key by its own covariance; keys with a singular one are left out. The driver has the p x p
    numbers of every key."""
    p = len(variables)
    aggs = [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(variables) for j, b in enumerate(variables) if i <= j]
    roots = []
    for row in df.groupBy(*keys).agg(*aggs).collect():
        values, vectors = np.linalg.eigh(np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float))
        if values.min() >= 1e-10:
            roots.append((*[row[k] for k in keys], [[float(v) for v in column] for column in (vectors / np.sqrt(values)).T]))
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)
    sent = df.sparkSession.createDataFrame(roots, f"{kinds}, _root array<array<double>>")
    values = F.array(*variables)
    scored = F.transform("_root", lambda column: total(F.zip_with(values, column, lambda a, b: a * b)))
    return df.join(F.broadcast(sent), list(keys)).withColumn(out, scored).drop("_root")


def check_domain(df: DataFrame, variables: list[str], name: str) -> None:
    """ValueError if the values do not suit the distance."""
    cols = [F.col(v).cast("double") for v in variables]
    unknown = sum((F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in cols), F.lit(0))
    binary = sum((F.when(~c.isin(0.0, 1.0), 1).otherwise(0) for c in cols), F.lit(0))
    negative = sum((F.when(c < 0, 1).otherwise(0) for c in cols), F.lit(0))
    spread = F.greatest(*cols) - F.least(*cols) if len(cols) > 1 else F.lit(0.0)
    row = df.agg(
        F.sum(unknown).alias("unknown"), F.sum(binary).alias("binary"), F.sum(negative).alias("negative"),
        F.count_if(sum(cols, F.lit(0.0)) <= 0).alias("empty"), F.count_if(spread == 0).alias("flat"),
    ).first()
    if name != "gower" and row["unknown"]:
        raise ValueError(f"{name} distance needs complete finite values")
    if name in BINARY and row["binary"]:
        raise ValueError(f"{name} distance needs 0/1 variables")
    if name in COUNT and (row["negative"] or row["empty"]):
        raise ValueError(f"{name} distance needs counts of 0 or more with a positive total per case")
    if name in ("correlation", "spearman") and row["flat"]:
        raise ValueError(f"{name} distance needs variation within every case")


def pairs(cases: DataFrame, name: str, weights: list[float] | None = None, ranges: list[float] | None = None, blocks: int = 8, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, d) with i < j for ``cases(id, x)``, within groups if ``group_cols`` are given.

    Cases are dealt into blocks by hash of id and joined block against block, so the work spreads over
    ``blocks`` * (``blocks`` + 1) / 2 keys; d is computed inside the join. This is the whole of N(N-1)/2 pairs: for
    jobs that need only sums over pairs use the aggregates of ``operators.evaluate``.
    """
    keyed = cases.select(*group_cols, "id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    cell = lambda other: F.struct(F.least("b", other).alias("lo"), F.greatest("b", other).alias("hi"))
    every = keyed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*group_cols, "id", "x", "b", cell(F.col("o")).alias("cell"))
    left = every.where(F.col("b") == F.col("cell.lo")).select(*group_cols, "cell", F.col("id").alias("p"), F.col("x").alias("px"))
    right = every.where(F.col("b") == F.col("cell.hi")).select(*group_cols, "cell", F.col("id").alias("q"), F.col("x").alias("qx"))
    met = left.join(right, [*group_cols, "cell"]).where((F.col("cell.lo") < F.col("cell.hi")) | (F.col("p") < F.col("q")))
    return met.select(*group_cols, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), distance(name, F.col("px"), F.col("qx"), weights, ranges).alias("d"))


def fill_unknown(pairs: DataFrame) -> DataFrame:
    """``pairs(i, j, d)`` in which pairs without a common variable have the largest distance, 1 at least."""
    most = pairs.agg(F.greatest(F.lit(1.0), F.max("d")).alias("_most"))
    return pairs.crossJoin(F.broadcast(most)).withColumn("d", F.coalesce("d", "_most")).drop("_most")
