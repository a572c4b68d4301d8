"""Describing a solution: profiles, tests of differences between clusters, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import matrices
from tessella.functions.hashing import key_uniform
from tessella.functions.tails import f_tail, tukey_tail
from tessella.operators import groups
from tessella.operators.order import ranked
from tessella.session import materialize

MAX_TESTED = 12


def profiles(cases: DataFrame, variables: list[str]) -> DataFrame:
    """(Cluster, N, Percent, mean of every variable) per cluster and for ``All`` cases, in one rollup."""
    names = {v: (f"{v} (variable)" if v in ("Cluster", "N", "Percent") else v) for v in variables}
    made = cases.rollup("cluster").agg(F.grouping("cluster").alias("_all"), F.count(F.lit(1)).alias("N"), *[F.avg(v).alias(f"_m_{i}") for i, v in enumerate(variables)])
    everyone = cases.agg(F.count(F.lit(1)).alias("_n"))
    return made.crossJoin(F.broadcast(everyone)).select(
        F.when(F.col("_all") == 1, "All").otherwise(F.col("cluster").cast("string")).alias("Cluster"), "N", (100 * F.col("N") / F.col("_n")).alias("Percent"), *[F.col(f"_m_{i}").alias(names[v]) for i, v in enumerate(variables)]
    )


def _long(cases: DataFrame, variables: list[str]) -> DataFrame:
    return cases.select("cluster", F.explode(F.array(*[F.struct(F.lit(v).alias("Variable"), F.col(v).cast("double").alias("v")) for v in variables])).alias("r")).select("cluster", "r.*").where("v is not null")


def _moments(cases: DataFrame, variables: list[str]) -> DataFrame:
    """Per variable and cluster: n, mean, and squares within, from one partial aggregation."""
    return _long(cases, variables).groupBy("Variable", "cluster").agg(F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("w"))


def variance_tests(cases: DataFrame, variables: list[str]) -> DataFrame:
    """(Variable, Eta_squared, F, df1, df2) of a one-way analysis of variance; F is null for no variance within.
    Constant variables, fewer than two clusters and n <= k give no row."""
    per = _moments(cases, variables)
    n = F.sum("n")
    row = per.groupBy("Variable").agg(n.alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / n).alias("b"))
    row = row.where((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("w") + F.col("b") > 0))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return row.select("Variable", (F.col("b") / (F.col("w") + F.col("b"))).alias("Eta_squared"), F.when(F.col("w") > 0, (F.col("b") / df1) / (F.col("w") / df2)).alias("F"), df1.cast("bigint").alias("df1"), df2.cast("bigint").alias("df2"))


def with_p(tests: DataFrame) -> DataFrame:
    """Adds p, the upper tail of F; one row per variable."""

    def tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else f_tail(x, p, q) for x, p, q in zip(f, a, b)], dtype="float64")

    return tests.withColumn("p", F.pandas_udf(tail, "double")("F", F.col("df1").cast("double"), F.col("df2").cast("double")))


def pairwise_differences(cases: DataFrame, variables: list[str]) -> DataFrame:
    """(Variable, Cluster_a, Cluster_b, Difference, q, k, df) for each pair of clusters: difference of means and
    its studentised range, for 2 to 12 clusters."""
    per = _moments(cases, variables)
    pooled = per.groupBy("Variable").agg(F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"), F.try_divide(F.sum("w"), F.sum("n") - F.count(F.lit(1))).alias("ms"))
    pooled = pooled.where(F.col("k").between(2, MAX_TESTED) & (F.col("df") > 0))
    a = per.select("Variable", F.col("cluster").alias("Cluster_a"), F.col("m").alias("ma"), F.col("n").alias("na"))
    b = per.select("Variable", F.col("cluster").alias("Cluster_b"), F.col("m").alias("mb"), F.col("n").alias("nb"))
    met = a.join(b, "Variable").where("Cluster_a < Cluster_b").join(pooled, "Variable")
    se = F.sqrt(F.col("ms") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    return met.select("Variable", "Cluster_a", "Cluster_b", (F.col("ma") - F.col("mb")).alias("Difference"), F.try_divide(F.abs(F.col("ma") - F.col("mb")), se).alias("q"), F.col("k").cast("bigint").alias("k"), F.col("df").cast("bigint").alias("df"))


def with_tukey(differences: DataFrame) -> DataFrame:
    def tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else tukey_tail(x, int(g), float(d)) for x, g, d in zip(q, k, df)], dtype="float64")

    return differences.withColumn("p_Tukey", F.pandas_udf(tail, "double")("q", "k", "df"))


def cluster_letters(k: int, different: set[tuple[int, int]]) -> list[str]:
    """Compact letter display of clusters 1..k: two share a letter if they do not differ."""
    groups = [set(range(1, k + 1))]
    for a, b in sorted(different):
        for g in [g for g in groups if a in g and b in g]:
            groups.remove(g)
            for part in (g - {a}, g - {b}):
                if part and not any(part <= other for other in groups):
                    groups.append(part)
        groups = [g for i, g in enumerate(groups) if not any(g < other for other in groups)]
    groups.sort(key=lambda g: sorted(g))
    return ["".join(chr(97 + i) for i, g in enumerate(groups) if c in g) for c in range(1, k + 1)]


def letters(tested: DataFrame, level: float = 0.05) -> DataFrame:
    """(Variable, Cluster, Letters) from pairwise tests (at most 12 clusters, 66 rows per variable)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = sorted({*pdf["Cluster_a"], *pdf["Cluster_b"]})
        number = {c: i + 1 for i, c in enumerate(labels)}
        sig = {(number[a], number[b]) for a, b, p in zip(pdf["Cluster_a"], pdf["Cluster_b"], pdf["p_Tukey"]) if p < level}
        return pd.DataFrame({"Variable": pdf["Variable"].iloc[0], "Cluster": labels, "Letters": cluster_letters(len(labels), sig)})

    return tested.groupBy("Variable").applyInPandas(run, f"Variable string, Cluster {dict(tested.dtypes)['Cluster_a']}, Letters string")


def top_eta(tests: DataFrame, how_many: int = 3) -> DataFrame:
    return tests.select("Variable", "Eta_squared").orderBy(F.desc("Eta_squared"), "Variable").limit(how_many)


def z_profiles(cases: DataFrame, variables: list[str]) -> DataFrame:
    """(cluster, Variable, Z): mean of each cluster in SD units of all cases; constant variables are left out."""
    long = _long(cases, variables)
    stats = long.groupBy("Variable").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).where("s > 0")
    means = long.groupBy("Variable", "cluster").agg(F.avg("v").alias("c"))
    return means.join(F.broadcast(stats), "Variable").select("cluster", "Variable", ((F.col("c") - F.col("m")) / F.col("s")).alias("Z"))


def principal_components(cases: DataFrame, variables: list[str], count: int = 2) -> tuple[DataFrame, list[float]]:
    """``cases`` with PC1, PC2, ... of the standardised variables and the percent of variance of each. A component's
    sign makes its largest loading positive."""
    p = len(variables)
    row = cases.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(variables)], *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(variables)], *[F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(variables) for j, b in enumerate(variables) if i < j]).first()
    corr = np.array([[1.0 if i == j else (row[f"c{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(p)] for i in range(p)])
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(-values)[:count]
    loading = vectors[:, order]
    loading = loading * np.sign(loading[np.abs(loading).argmax(0), range(loading.shape[1])])
    score = lambda c: sum(((F.col(v) - row[f"m{i}"]) / (row[f"s{i}"] or 1.0) * float(loading[i, c]) for i, v in enumerate(variables)), F.lit(0.0))
    return cases.withColumns({f"PC{c + 1}": score(c) for c in range(len(order))}), [100 * float(v) / p for v in values[order]]


def scaling_2d(pairs: DataFrame, ids: DataFrame, rounds: int = 30) -> DataFrame:
    """Classical multidimensional scaling to two dimensions of pairs(i, j, d): double centring by row means of the
    squared distances, then power iteration with deflation; a round is a join and an aggregation."""
    both = pairs.select("i", "j", (F.col("d") * F.col("d")).alias("q")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("d") * F.col("d")).alias("q")))
    n = ids.count()
    means = both.groupBy("i").agg((F.sum("q") / n).alias("r"))
    grand = means.agg(F.avg("r")).first()[0]
    own = ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("q"))
    full = both.unionByName(own).join(means, "i").join(means.select(F.col("i").alias("j"), F.col("r").alias("rj")), "j")
    gram = materialize(full.select("i", "j", (-0.5 * (F.col("q") - F.col("r") - F.col("rj") + grand)).alias("g")))
    out, found = ids.select("id"), []
    for c in range(2):
        v = materialize(ids.select(F.col("id").alias("j"), (key_uniform("scaling", str(c), F.col("id")) - 0.5).alias("v")))
        value = 0.0
        for _ in range(rounds):
            w = gram.join(v, "j").groupBy("i").agg(F.sum(F.col("g") * F.col("v")).alias("v"))
            for vec, val in found:
                scale = v.join(vec.withColumnRenamed("v", "u"), "j").agg(F.sum(F.col("v") * F.col("u"))).first()[0]
                w = w.join(vec.select(F.col("j").alias("i"), F.col("v").alias("u")), "i").select("i", (F.col("v") - val * scale * F.col("u")).alias("v"))
            w = materialize(w)
            value = w.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
            if not value:
                break
            v = w.select(F.col("i").alias("j"), (F.col("v") / value).alias("v"))
        v = materialize(v)
        found.append((v, value))
        out = out.join(v.select(F.col("j").alias("id"), (F.col("v") * float(value) ** 0.5).alias(f"Dim{c + 1}")), "id")
    return out


def landmark_scaling(cases: DataFrame, name: str, weights: list[float] | None = None, ranges: list[float] | None = None, count: int = 500, seed: int = 2026) -> DataFrame:
    """(id, Dim1, Dim2): classical multidimensional scaling of ``cases(id, x)`` to two dimensions by landmarks.

    Up to ``count`` cases, drawn by hash, are scaled on the driver from their distances; every case is then placed by its
    squared distances to them, in one pass. If all cases are landmarks, this is the classical solution. A dimension without
    extent is zero; the landmark farthest out has a positive coordinate. Pairs without a common variable have the largest distance.
    """
    _, chosen = groups.place_cases(cases.select("id", "x"), name, count, weights, ranges, (), seed)
    x = matrices.points([r["x"] for r in chosen.orderBy("rep").collect()])
    if not len(x):
        return cases.select("id", F.lit(0.0).alias("Dim1"), F.lit(0.0).alias("Dim2"))
    d = matrices.square(name, x, weights, ranges)
    most, q = max(1.0, float(d.max())), d * d
    centred = -0.5 * (q - q.mean(0) - q.mean(1)[:, None] + q.mean())
    values, vectors = np.linalg.eigh((centred + centred.T) / 2)
    values, vectors = values[::-1][:2], vectors[:, ::-1][:, :2]
    live = values > 1e-9 * max(float(np.abs(values).max()), 1e-300)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    place = np.where(live, vectors * sign / np.sqrt(np.where(live, values, 1.0)), 0.0)
    mean = q.mean(0)

    def run(column: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(column), 2))
        for i in range(0, len(column), 1000):
            far = matrices.matrix(name, matrices.points(column.iloc[i : i + 1000]), x, weights, ranges)
            far = np.where(np.isnan(far), most, far)
            if name == "russell_rao":  # a case and itself are at zero
                same = (matrices.points(column.iloc[i : i + 1000])[:, None] == x[None]).all(2)
                far = np.where(same, 0.0, far)
            out[i : i + 1000, : place.shape[1]] = -0.5 * (far * far - mean) @ place
        return pd.DataFrame(out, columns=["Dim1", "Dim2"])

    return cases.select("id", F.pandas_udf(run, "Dim1 double, Dim2 double")("x").alias("_d")).select("id", "_d.*")


def heat_map(cases: DataFrame, variables: list[str]) -> DataFrame:
    """(cluster, Position, id, z of every variable clipped to 2.5): cases in order of the first component within
    their cluster."""
    scored, _ = principal_components(cases, variables, 1)
    stats = cases.agg(*[F.avg(v).alias(f"_m{i}") for i, v in enumerate(variables)], *[F.stddev_samp(v).alias(f"_s{i}") for i, v in enumerate(variables)])
    z = [F.greatest(F.lit(-2.5), F.least(F.lit(2.5), (F.col(v) - F.col(f"_m{i}")) / F.col(f"_s{i}"))).alias(v) for i, v in enumerate(variables)]
    return ranked(scored, ("cluster",), ["PC1", "id"], "Position").crossJoin(F.broadcast(stats)).select("cluster", "Position", "id", *z)
