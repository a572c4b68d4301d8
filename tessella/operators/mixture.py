"""Gaussian mixtures by EM: a round is one pass over the cases for all groups and covariance models at once.

Covariance models by volume, shape and orientation: EII, VII (spherical), EEI, VVI (diagonal), EEE, VVV (full);
E is shared by all components, V free. The parameters of every group (value of the keys) and model stay with the
driver, components times (p + p^2) numbers each; tasks add up their cases under them and Spark adds the sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import kmeans
from tessella.session import materialize

MODELS = ("EII", "VII", "EEI", "VVI", "EEE", "VVV")


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    parameters: int
    model: str
    rounds: int = 0
    converged: bool = False

    def bic(self, n: int) -> float:
        return -2 * self.log_likelihood + self.parameters * math.log(n)


def parameters_of(model: str, k: int, p: int) -> int:
    shape = {"EII": 1, "VII": k, "EEI": p, "VVI": k * p, "EEE": p * (p + 1) // 2, "VVV": k * p * (p + 1) // 2}[model]
    return k - 1 + k * p + shape


def covariances(model: str, scatter: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Component covariances from weighted scatter matrices (k, p, p) and weights n."""
    k, p, _ = scatter.shape
    total = scatter.sum(0) / n.sum()
    eye = np.eye(p)
    if model == "EII":
        return np.repeat((np.trace(total) / p * eye)[None], k, 0)
    if model == "VII":
        return np.array([np.trace(s) / (p * m) * eye for s, m in zip(scatter, n)])
    if model == "EEI":
        return np.repeat(np.diag(np.diag(total))[None], k, 0)
    if model == "VVI":
        return np.array([np.diag(np.diag(s / m)) for s, m in zip(scatter, n)])
    if model == "EEE":
        return np.repeat(total[None], k, 0)
    return scatter / n[:, None, None]


def densities(x: np.ndarray, mix: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (rows, components) and log densities of points."""
    logs = np.empty((len(x), len(mix.weights)))
    for c, (weight, mean, cov) in enumerate(zip(mix.weights, mix.means, mix.covariances)):
        root = np.linalg.inv(np.linalg.cholesky(cov))
        logs[:, c] = math.log(max(weight, 1e-300)) + np.log(np.diag(root)).sum() - len(mean) / 2 * math.log(2 * math.pi) - 0.5 * (((x - mean) @ root.T) ** 2).sum(1)
    top = logs.max(1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return np.exp(logs - ll[:, None]), ll


def posteriors(cases: DataFrame, mix: Mixture) -> DataFrame:
    """cases with ``prob`` (array, one per component) and ``ll`` (log density)."""

    def run(x: pd.Series) -> pd.DataFrame:
        prob, ll = densities(np.array(x.tolist(), float).reshape(len(x), -1), mix)
        return pd.DataFrame({"prob": list(prob), "ll": ll})

    scored = F.pandas_udf(run, "prob array<double>, ll double")
    return cases.withColumn("_g", scored("x")).select(*cases.columns, "_g.prob", "_g.ll")


def _sums(slots: list[tuple[int, Mixture | None]], k: int, p: int):
    """Cells of each slot: per component the weight, the weighted sum and products of x; then log-likelihood and number.
    Without a mixture the labels of the cases are their posteriors."""
    width = k * (1 + p + p * p) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(slots), width))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            group, label = batch.column("_g").to_numpy(zero_copy_only=False), batch.column("cluster").to_numpy(zero_copy_only=False)
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                mine = x[at]
                for s, (of, mix) in enumerate(slots):
                    if of != g:
                        continue
                    prob, ll = densities(mine, mix) if mix is not None else ((label[at][:, None] == np.arange(1, k + 1)).astype(float), np.zeros(len(at)))
                    sums, products = prob.T @ mine, np.stack([(mine * prob[:, c, None]).T @ mine for c in range(k)])
                    total[s] += np.concatenate([prob.sum(0), sums.ravel(), products.ravel(), [ll.sum(), len(at)]])
        used = np.flatnonzero(total[:, -1])
        slot, cell = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[used].ravel())], names=["slot", "cell", "v"])

    return run, width


def _fitted(sums: np.ndarray, k: int, p: int, model: str) -> tuple[Mixture, float]:
    """The mixture of one slot's sums, and the log-likelihood of the one before."""
    n = np.maximum(sums[:k], 1e-9)
    means = sums[k : k + k * p].reshape(k, p) / n[:, None]
    products = sums[k + k * p : -2].reshape(k, p, p)
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    cov = covariances(model, scatter, n) + 1e-9 * np.eye(p)
    np.linalg.cholesky(cov)  # an error if a component has collapsed
    return Mixture(n / sums[-1], means, cov, -math.inf, parameters_of(model, k, p), model), float(sums[-2])


def em_keys(started: DataFrame, k: int, models: tuple[str, ...], keys: tuple[str, ...] = (), rounds: int = 100, tolerance: float = 1e-8) -> dict[tuple, dict[str, Mixture]]:
    """Mixtures of every key of ``started(keys, id, x, cluster)`` and covariance model, from their partition.

    All keys and models take part in the same passes until their log-likelihood grows by less than ``tolerance``
    of itself, or for ``rounds``; ``converged`` says which. It never falls. Models that collapse are left out.
    """
    for model in models:
        if model not in MODELS:
            raise ValueError(f"unknown covariance model {model!r}")
    p = kmeans.dimensions(started)
    names = [tuple(r) for r in started.select(*keys).distinct().collect()] if keys else [()]
    rows = started.select(*keys, "x", F.col("cluster").cast("int").alias("cluster"))
    if keys:
        kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
        numbers = started.sparkSession.createDataFrame([(*n, g) for g, n in enumerate(names)], f"{kinds}, _g int")
        rows = rows.join(F.broadcast(numbers), list(keys))
    else:
        rows = rows.withColumn("_g", F.lit(0))
    rows = materialize(rows.select("_g", "x", "cluster"))
    slots = [(g, m) for g in range(len(names)) for m in models]
    found: dict[tuple[int, str], Mixture | None] = {s: None for s in slots}
    active = list(slots)
    for step in range(rounds + 1):
        if not active:
            break
        run, width = _sums([(g, found[g, m]) for g, m in active], k, p)
        table = np.zeros((len(active), width))
        for slot, cell, v in rows.mapInArrow(run, "slot int, cell int, v double").groupBy("slot", "cell").agg(F.sum("v")).collect():
            table[slot, cell] = v
        left = []
        for (g, m), sums in zip(active, table):
            old = found[g, m]
            try:
                new, ll = _fitted(sums, k, p, m)
            except np.linalg.LinAlgError:
                found.pop((g, m))
                continue
            if old is None:
                found[g, m] = new
            else:  # the sums are under the old one: its likelihood is known now
                rest = ll - old.log_likelihood <= tolerance * abs(ll) if math.isfinite(old.log_likelihood) else False
                if rest or step == rounds:
                    found[g, m] = replace(old, log_likelihood=ll, rounds=step, converged=rest)
                    continue
                found[g, m] = replace(new, log_likelihood=ll)
            left.append((g, m))
        active = left
    out: dict[tuple, dict[str, Mixture]] = {n: {} for n in names}
    for (g, m), mix in found.items():
        if mix is not None and math.isfinite(mix.log_likelihood):
            out[names[g]][m] = mix
    return out


def em(cases: DataFrame, k: int, model: str, rounds: int = 100, tolerance: float = 1e-8, seed: int = 2026, start: DataFrame | None = None) -> Mixture:
    """Fit by EM from a k-means start (or ``start(id, x, cluster)``). The log-likelihood never falls."""
    first = start if start is not None else kmeans.kmeans(cases.select("id", "x"), k, 5, 10, seed)
    made = em_keys(first, k, (model,), (), rounds, tolerance)[()]
    if model not in made:
        raise np.linalg.LinAlgError(f"a component of {model} has collapsed")
    return made[model]


def gmm(cases: DataFrame, k: int, covariance: str = "BIC", rounds: int = 100, seed: int = 2026) -> tuple[DataFrame, Mixture]:
    """(cases with cluster and prob, mixture): the given covariance model, or the one of lowest BIC."""
    n = cases.count()
    start = materialize(kmeans.kmeans(cases.select("id", "x"), k, 5, 10, seed))
    made = em_keys(start, k, MODELS if covariance == "BIC" else (covariance,), (), rounds)[()]
    if not made:
        raise ValueError("no covariance model could be fitted")
    best = min(made.values(), key=lambda mix: mix.bic(n))
    label = F.array_position("prob", F.array_max("prob")).cast("int")
    return posteriors(cases, best).withColumn("cluster", label), best


def gmm_keys(cases: DataFrame, k: int, keys: tuple[str, ...], covariance: str = "BIC", rounds: int = 100, seed: int = 2026) -> DataFrame:
    """(keys, id, x, cluster): the mixture of each key, by its own best model. Keys without a mixture have no rows."""
    start = materialize(kmeans.kmeans(cases.select(*keys, "id", "x"), k, 5, 10, seed, keys=keys))
    sizes = {tuple(r[:-1]): r[-1] for r in start.groupBy(*keys).count().collect()}
    fitted = em_keys(start, k, MODELS if covariance == "BIC" else (covariance,), keys, rounds)
    best = {name: min(made.values(), key=lambda mix: mix.bic(sizes[name])) for name, made in fitted.items() if made}  # noqa: B023
    names = list(best)
    kinds = ", ".join(f"`{c}` {t}" for c, t in start.select(*keys).dtypes)
    numbers = cases.sparkSession.createDataFrame([(*n, g) for g, n in enumerate(names)], f"{kinds}, _g int")
    mixtures = [best[n] for n in names]

    def run(group: pd.Series, x: pd.Series) -> pd.Series:
        points, of, out = np.array(x.tolist(), float).reshape(len(x), -1), group.to_numpy(), np.zeros(len(x), np.int32)
        for g in np.unique(of):
            out[of == g] = densities(points[of == g], mixtures[g])[0].argmax(1) + 1
        return pd.Series(out)

    met = cases.select(*keys, "id", "x").join(F.broadcast(numbers), list(keys))
    return met.select(*keys, "id", "x", F.pandas_udf(run, "int")("_g", "x").alias("cluster"))
