"""Filling in missing values: means, nearest donors, and chained equations.

Numbers are doubles, missing is null. Every function takes a table with a key column ``id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import key_uniform
from tessella.operators import blocks
from tessella.operators.profile import missing_count
from tessella.session import indexed, materialize


def fillable(variables: list[str], max_missing: float) -> Column:
    """Cases with a share of missing values up to ``max_missing`` and at least one value."""
    n = missing_count(variables)
    return (n <= max_missing * len(variables)) & (n < len(variables))


def mean_impute(df: DataFrame, variables: list[str], max_missing: float = 0.5) -> DataFrame:
    means = df.agg(*[F.avg(v).alias(f"_mean_{v}") for v in variables])
    may = fillable(variables, max_missing)
    filled = df.crossJoin(F.broadcast(means)).withColumn("_may", may)
    return filled.withColumns({v: F.when(F.col("_may"), F.coalesce(F.col(v), F.col(f"_mean_{v}"))).otherwise(F.col(v)) for v in variables}).select(*df.columns)


#: Donors from which the cuts of their space are taken, and donors of a block.
CUT_CASES, DONOR_BLOCK = 20_000, 4000


def _cuts(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, value) of the nodes of a tree of halves, widest dimension first; node i has children 2i + 1 and 2i + 2."""
    parts: list[np.ndarray] = [points]
    nodes: list[tuple[int, float]] = []
    for i in range(2**depth - 1):
        mine = parts[i]
        j = int(np.argmax(np.ptp(mine, 0))) if len(mine) else 0
        at = float(np.median(mine[:, j])) if len(mine) else 0.0
        nodes.append((j, at))
        parts += [mine[mine[:, j] < at], mine[mine[:, j] >= at]] if len(mine) else [mine, mine]
    return nodes


def nearest_donors(z: DataFrame, variables: list[str], weights: tuple[float, ...], threshold: float, max_missing: float = 0.5) -> DataFrame:
    """ID, Donor_ID, ASED: for each incomplete case the complete case of smallest weighted mean squared
    difference over the variables the case has; equal differences go to the smaller id.

    Donors are packed into blocks of near ones (a sample says where their space is cut), recipients likewise, and every block of
    recipients meets those of donors, the nearest first: a block whose bounding box is farther from all recipients than
    what they have is passed over. So no pair is written, and few are compared.
    """
    n = missing_count(variables)
    values = F.array(*[F.col(v).cast("double") for v in variables]).alias("x")
    recipients = materialize(z.where((n > 0) & fillable(variables, max_missing)).select("id", values))
    donors = materialize(z.where(n == 0).select("id", values))
    kind, w = dict(donors.dtypes)["id"], np.array(weights, float)
    count = max(1, donors.count())
    depth = max(0, math.ceil(math.log2(count / DONOR_BLOCK))) if count > DONOR_BLOCK else 0
    drawn = donors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // CUT_CASES))) == 0).limit(2 * CUT_CASES).select("x").collect() if depth else []
    cuts = _cuts(np.array([r["x"] for r in drawn], float).reshape(len(drawn), len(variables)), depth)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(variables))
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                j, at = np.array([c[0] for c in cuts])[node], np.array([c[1] for c in cuts])[node]
                node = 2 * node + np.where(x[np.arange(len(x)), j] >= at, 2, 1)  # unknown: the lower half
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array((node - (2**depth - 1)).astype(np.int32))], names=["id", "x", "cell"])

    def packed(rows: DataFrame) -> DataFrame:
        placed = rows.mapInArrow(cells, f"id {kind}, x array<double>, cell int")
        return blocks.packed(placed, 2**depth, F.col("cell")).select("block", "id", "x")

    def meet(a: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        x, size = a["x"], len(a["id"])
        known = ~np.isnan(x)
        mass = known @ w
        best, donor = np.full(size, np.inf), a["id"].copy()
        kinds = [(p, np.flatnonzero((known == p).all(1))) for p in np.unique(known, axis=0)]

        def gap(rows: np.ndarray, at: np.ndarray, pattern: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), len(at)))
            for j in np.flatnonzero(pattern):
                out += w[j] * (rows[:, j, None] - at[None, :, j]) ** 2
            return out

        near = [(b, b["x"].min(0), b["x"].max(0)) for b in others]
        middle = np.where(known, x, 0.0).sum(0) / np.maximum(known.sum(0), 1)
        near.sort(key=lambda t: float((w * np.maximum(np.maximum(t[1] - middle, middle - t[2]), 0.0) ** 2).sum()))
        for b, low, high in near:
            for pattern, rows in kinds:
                mine = x[rows]
                apart = np.where(pattern, np.maximum(np.maximum(low - mine, mine - high), 0.0), 0.0)
                reach = (apart * apart) @ w / mass[rows]
                open_ = rows[(reach <= best[rows] * (1 + 1e-12)) & (reach <= threshold * (1 + 1e-12))]
                for i in range(0, len(open_), 1000):
                    part = open_[i : i + 1000]
                    d = gap(x[part], b["x"], pattern) / mass[part, None]
                    at = d.argmin(1)  # sorted by id: the first is the smallest
                    low_, to = d[np.arange(len(part)), at], b["id"][at]
                    better = (low_ < best[part]) | ((low_ == best[part]) & (to < donor[part]))
                    best[part[better]], donor[part[better]] = low_[better], to[better]
        some = np.isfinite(best)
        yield blocks.batch({"r": a["id"][some], "d": donor[some], "ased": best[some]})

    scored = blocks.crossed(packed(recipients), meet, f"r {kind}, d {kind}, ased double", packed(donors))
    best = scored.groupBy("r").agg(F.min(F.struct("ased", "d")).alias("s"))
    return best.where(F.col("s.ased") <= threshold).select(F.col("r").alias("ID"), F.col("s.d").alias("Donor_ID"), F.col("s.ased").alias("ASED"))


def neighbour_impute(df: DataFrame, z: DataFrame, variables: list[str], weights: tuple[float, ...], threshold: float, max_missing: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``df`` with missing values of each case taken from its nearest donor, and the donor report.
    ``z`` is ``df`` scaled. Cases filled in are never donors."""
    report = materialize(nearest_donors(z, variables, weights, threshold, max_missing))
    values = df.select(F.col("id").alias("Donor_ID"), *[F.col(v).alias(f"_d_{v}") for v in variables])
    given = report.join(values, "Donor_ID").drop("Donor_ID", "ASED")
    filled = df.join(given, df["id"] == given["ID"], "left")
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_d_{c}")).alias(c) if c in variables else df[c] for c in df.columns]), report


def _ranked(ordered: DataFrame) -> DataFrame:
    """``ordered(imputation, id, y, gap, mean)`` with ``rank``: the number of observed rows up to each row in order
    of imputation, mean and id, by ranges and their prefix sums."""
    order = ("imputation", "mean", "id")
    dealt = materialize(ordered.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    observed = F.when(F.col("gap"), 0).otherwise(1).cast("bigint")
    sizes = dealt.groupBy("part").agg(F.sum(observed).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum(observed).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return materialize(dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + within).drop("part", "before"))


#: Levels of a text variable that is imputed, and coefficients of its model.
MAX_LEVELS, MAX_COEFFICIENTS = 50, 600


@dataclass(frozen=True)
class Logits:
    """Multinomial (for two levels logistic) models of several keys: coefficients (levels - 1, terms) and the inverse of the
    information of each. Level 0 is the base."""

    beta: dict[int, np.ndarray]
    covariance: dict[int, np.ndarray]
    rounds: int


def _shares(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Probabilities of all levels."""
    eta = np.concatenate([np.zeros((len(x), 1)), x @ beta.T], 1)
    eta = np.exp(eta - eta.max(1, keepdims=True))
    return eta / eta.sum(1, keepdims=True)


def fit_logits(rows: DataFrame, levels: int, keys: list[int], ridge: float = 1e-6, rounds: int = 50, start: dict[int, np.ndarray] | None = None) -> Logits:
    """Newton's method for every key at once on ``rows(key, y, x)``, y from 0 to levels - 1.

    A round is one pass: tasks add up the gradient, the information and the log-likelihood of each key under its
    coefficients, Spark adds the parts, and the driver solves the (levels - 1) * terms equations of each key. Keys that
    have come to rest take no further part; a step that lowers the likelihood is halved. The ridge (per row) keeps levels
    that the terms tell apart perfectly at finite coefficients. ``start`` holds coefficients to begin with, of an earlier sweep.
    """
    p = rows.select(F.size("x").alias("p")).first()["p"]
    free = levels - 1
    size = free * p
    if size > MAX_COEFFICIENTS:
        raise ValueError(f"a model of {size} coefficients: at most {MAX_COEFFICIENTS}")

    def sums(beta: dict[int, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(size + size * size + 2) for k in beta}
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
                key, y = batch.column("key").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
                for k, b in beta.items():
                    mine, of = x[key == k], y[key == k]
                    if not len(mine):
                        continue
                    prob = _shares(mine, b)
                    gap = (of[:, None] == np.arange(1, levels)) - prob[:, 1:]
                    info = np.zeros((free, p, free, p))
                    for i in range(free):
                        for j in range(i, free):
                            w = prob[:, i + 1] * ((i == j) - prob[:, j + 1])
                            info[i, :, j] = (mine * w[:, None]).T @ mine
                            info[j, :, i] = info[i, :, j].T
                    ll = np.log(np.maximum(prob[np.arange(len(of)), of], 1e-300)).sum()
                    total[k] += np.concatenate([(gap.T @ mine).ravel(), info.ravel(), [ll, len(of)]])
            used = [k for k, t in total.items() if t[-1]]
            width = size + size * size + 2
            columns = [np.repeat(np.array(used, np.int32), width), np.tile(np.arange(width, dtype=np.int32), len(used)), np.concatenate([total[k] for k in used]) if used else np.empty(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "cell", "v"])

        return run

    beta = {k: (start or {}).get(k, np.zeros((free, p))) for k in keys}
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # log-likelihood, coefficients, step from there
    covariance: dict[int, np.ndarray] = {}
    active, step = list(keys), 0
    for step in range(1, rounds + 1):
        found = {k: np.zeros(size + size * size + 2) for k in active}
        parts = rows.select(F.col("key").cast("int").alias("key"), F.col("y").cast("int").alias("y"), "x").mapInArrow(sums({k: beta[k] for k in active}), "key int, cell int, v double")
        for k, cell, v in parts.groupBy("key", "cell").agg(F.sum("v")).collect():
            found[k][cell] = v
        left = []
        for k in active:
            n = found[k][-1]
            if not n:
                continue
            penalty = ridge * n
            ll = found[k][-2] - penalty / 2 * float((beta[k] ** 2).sum())
            if k in best and ll < best[k][0] - 1e-9 * abs(best[k][0]):  # too far: half the step
                at, move = best[k][1], best[k][2] / 2
                best[k] = (best[k][0], at, move)
            else:
                gradient = found[k][:size] - penalty * beta[k].ravel()
                information = found[k][size:-2].reshape(size, size) + penalty * np.eye(size)
                covariance[k] = np.linalg.inv(information)
                at, move = beta[k], (covariance[k] @ gradient).reshape(free, p)
                best[k] = (ll, at, move)
            if np.abs(move).max() < 1e-8:
                continue
            beta[k] = at + move
            left.append(k)
        active = left
        if not active:
            break
    return Logits(beta, covariance, step)


def drawn_levels(rows: DataFrame, models: Logits, seed: int, sweep: int, name: str) -> DataFrame:
    """(imputation, id, _new): a level for each of ``rows(imputation, id, x)``, drawn by hash from the probabilities under coefficients
    that are drawn around the fitted ones."""
    rng = np.random.default_rng([seed, sweep, *name.encode()])
    drawn = {}
    for k, beta in sorted(models.beta.items()):
        if k in models.covariance:
            root = np.linalg.cholesky((models.covariance[k] + models.covariance[k].T) / 2 + 1e-15 * np.eye(beta.size))
            drawn[k] = beta + (root @ rng.standard_normal(beta.size)).reshape(beta.shape)

    def run(key: pd.Series, u: pd.Series, x: pd.Series) -> pd.Series:
        points, out = np.array(x.tolist(), float).reshape(len(x), -1), np.zeros(len(x))
        for k in key.unique():
            at = (key == k).to_numpy()
            upto = np.cumsum(_shares(points[at], drawn[int(k)]), 1)
            out[at] = np.minimum((u[at].to_numpy()[:, None] >= upto).sum(1), upto.shape[1] - 1)
        return pd.Series(out)

    u = key_uniform(str(seed), "level", str(sweep), name, F.col("imputation"), F.col("id"))
    return rows.select("imputation", "id", F.pandas_udf(run, "double")("imputation", u, "x").alias("_new"))


def _levels(df: DataFrame, v: str) -> list[str]:
    found = [r[0] for r in df.select(v).where(F.col(v).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{v} has more than {MAX_LEVELS} values: too many for a model of its levels")
    return sorted(found)


def multiple_impute(df: DataFrame, variables: list[str], m: int = 5, sweeps: int = 5, seed: int = 2026, donors: int = 5) -> DataFrame:
    """``m`` completed copies of ``df(id, variables)``, with a column ``imputation`` from 1.

    Chained equations, all copies at once in each sweep and for each variable. Numbers: predictive mean matching; the
    normal equations are sums over the observed rows (one aggregation), a coefficient draw is made from them on
    the driver (p x p numbers per copy), and each missing cell takes the value of one of the nearest observed
    cases by predicted mean, however far they are in order. Text: a logistic model for two values, a multinomial
    one for more (``fit_logits``), a coefficient draw, and a draw from the probabilities. Text takes part in the
    other models as indicators of its levels. Draws are hashes of copy, sweep, variable and case. A variable without any
    value stays missing.
    """
    text = {v: _levels(df, v) for v, t in df.select(*variables).dtypes if t == "string"}
    codes = {v: F.create_map(*[F.lit(x) for i, level in enumerate(text[v]) for x in (level, float(i))]) if text[v] else None for v in text}
    coded = df.select("id", *[(F.try_element_at(codes[v], F.col(v)) if codes[v] is not None else F.lit(None).cast("double")).alias(v) if v in text else F.col(v).cast("double").alias(v) for v in variables])
    seen = coded.agg(*[F.count(v).alias(v) for v in variables]).first().asDict()
    usable = [v for v in variables if seen[v]]
    missing = {v: F.col(v).isNull() for v in usable}
    incomplete = [v for v in usable if not coded.where(missing[v]).isEmpty()]
    stats = coded.agg(*[f(v).alias(f"{a}_{v}") for v in usable for a, f in (("m", F.avg), ("s", F.stddev_samp))]).first().asDict()

    def begun(v: str) -> Column:
        """A first value: the mean, or a level drawn as often as it is seen."""
        if v not in text:
            return F.lit(stats[f"m_{v}"])
        counts = dict(coded.where(~missing[v]).groupBy(v).count().collect())
        upto = np.cumsum([counts.get(float(i), 0) for i in range(len(text[v]))]) / seen[v]
        u = key_uniform(str(seed), "begin", v, F.col("imputation"), F.col("id"))
        return sum(((u >= float(c)).cast("double") for c in upto[:-1]), F.lit(0.0))

    def terms_for(v: str, scaled: bool = False) -> list[Column]:
        terms = [F.lit(1.0)]
        for u in usable:
            if u != v and u in text:
                terms += [(F.col(u) == float(i)).cast("double") for i in range(1, len(text[u]))]
            elif u != v:
                terms.append((F.col(u) - float(stats[f"m_{u}"])) / float(stats[f"s_{u}"] or 1.0) if scaled else F.col(u))
        return terms

    copies = coded.withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(m))))
    state = materialize(copies.withColumns({f"_gap_{v}": missing[v] for v in incomplete}).withColumns({v: F.coalesce(F.col(v), begun(v)) for v in incomplete}))
    rng = np.random.default_rng(seed)
    fitted: dict[str, dict[int, np.ndarray]] = {}
    for sweep in range(sweeps):
        for v in incomplete:
            if v in text:
                filled = None
                if len(text[v]) > 1:
                    x = F.array(*terms_for(v, scaled=True)).alias("x")
                    observed = materialize(state.where(~F.col(f"_gap_{v}")).select(F.col("imputation").alias("key"), F.col(v).cast("int").alias("y"), x))
                    models = fit_logits(observed, len(text[v]), list(range(1, m + 1)), start=fitted.get(v))
                    fitted[v] = models.beta
                    filled = drawn_levels(state.where(F.col(f"_gap_{v}")).select("imputation", "id", x), models, seed, sweep, v)
            else:
                filled = _matched(state, v, terms_for(v), rng, seed, sweep, donors)
            if filled is not None:
                state = state.join(filled, ["imputation", "id"], "left").withColumn(v, F.when(F.col(f"_gap_{v}"), F.coalesce("_new", F.col(v))).otherwise(F.col(v))).drop("_new")
                state = materialize(state)
    names = {v: F.array(*[F.lit(x) for x in text[v]])[F.col(v).cast("int")].alias(v) for v in text if text[v]}
    return state.select("imputation", "id", *[F.lit(None).cast("string").alias(v) if v in text and not text[v] else names.get(v, F.col(v)) for v in variables])


def _matched(state: DataFrame, v: str, terms: list[Column], rng: np.random.Generator, seed: int, sweep: int, donors: int) -> DataFrame:
    """(imputation, id, _new): a value of one of the nearest observed cases by predicted mean, for each gap of ``v``."""
    p = len(terms)
    products = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    sums = [*products, *[F.sum(t * F.col(v)).alias(f"b{i}") for i, t in enumerate(terms)], F.sum(F.col(v) * F.col(v)).alias("yy"), F.count(F.lit(1)).alias("n")]
    rows = state.where(~F.col(f"_gap_{v}")).groupBy("imputation").agg(*sums).orderBy("imputation").collect()
    draws = []
    for r in rows:
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
        a += np.diag(np.where(np.diag(a) > 0, 1e-8 * np.diag(a), 1.0))  # a level that nobody has gets coefficient 0
        b = np.array([r[f"b{i}"] for i in range(p)], float)
        beta = np.linalg.solve(a, b)
        sigma2 = max(float(r["yy"] - beta @ b), 1e-12) / max(rng.chisquare(max(r["n"] - p, 1)), 1e-12)
        drawn = beta + np.linalg.cholesky(np.linalg.inv(a) * sigma2 + 1e-15 * np.eye(p)) @ rng.standard_normal(p)
        draws.append((r["imputation"], beta, drawn))
    fit = lambda which: F.element_at(F.create_map(*[x for d in draws for x in (F.lit(d[0]), sum((terms[i] * float(d[which][i]) for i in range(p)), F.lit(0.0)))]), F.col("imputation"))
    # Observed cases by fitted mean, missing cells by drawn mean: matched in order.
    ordered = state.select("imputation", "id", F.col(v).alias("y"), F.col(f"_gap_{v}").alias("gap"), F.when(F.col(f"_gap_{v}"), fit(2)).otherwise(fit(1)).alias("mean"))
    ranked = _ranked(ordered)
    near = ranked.where("gap").select("imputation", "id", F.col("mean").alias("_mean"), F.explode(F.sequence(F.col("rank") - (donors - 1), F.col("rank") + donors)).alias("rank"))
    near = near.join(ranked.where("not gap").select("imputation", "rank", "mean", "y"), ["imputation", "rank"])
    nearest = F.slice(F.array_sort(F.collect_list(F.struct(F.abs(F.col("mean") - F.col("_mean")).alias("d"), "rank", "y"))), 1, donors)
    pick = F.floor(key_uniform(str(seed), str(sweep), v, F.col("imputation"), F.col("id")) * F.size("_pool")).cast("int")
    return near.groupBy("imputation", "id").agg(nearest.alias("_pool")).select("imputation", "id", F.col("_pool")[pick]["y"].alias("_new"))


def consensus_classes(memberships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, pairs) of ``memberships(imputation, id, cluster)``.

    Cases with the same clusters in the same imputations are one class: classes(class, Cases, First), named by their rank in order
    of the signature, members(id, class). Their consensus is that of their classes: pairs(a, b, Consensus, Imputations), a <= b, of classes
    that ever share a cluster. So the table grows with the classes, not with the pairs of cases.
    """
    signature = F.array_sort(F.collect_list(F.struct("imputation", "cluster")))
    signed = materialize(memberships.groupBy("id").agg(signature.alias("s")))
    kinds = materialize(signed.groupBy("s").agg(F.count(F.lit(1)).alias("Cases"), F.min("id").alias("First")))
    named = materialize(indexed(kinds, "First").select((F.col("index") + 1).alias("class"), "s", "Cases", "First"))
    members = signed.join(named.select("s", "class"), "s").select("id", "class")
    one = named.select("class", F.explode("s").alias("m")).select("class", "m.imputation", "m.cluster")
    a, b = one.withColumnRenamed("class", "a"), one.withColumnRenamed("class", "b")
    together = a.join(b, ["imputation", "cluster"]).where("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("t"))
    held = named.select("class", F.transform("s", lambda m: m["imputation"]).alias("in"))
    both = together.join(held.select(F.col("class").alias("a"), F.col("in").alias("in_a")), "a").join(held.select(F.col("class").alias("b"), F.col("in").alias("in_b")), "b")
    n = F.size(F.array_intersect("in_a", "in_b"))
    return named.select("class", "Cases", "First"), members, both.select("a", "b", (F.col("t") / n).alias("Consensus"), n.cast("bigint").alias("Imputations"))


def consensus(memberships: DataFrame) -> DataFrame:
    """i, j, Consensus, Imputations for pairs of cases that ever share a cluster in ``memberships(imputation, id,
    cluster)``: the share of imputations holding both in which they are together. Expanded from the classes; for many cases
    read those."""
    _, members, pairs = consensus_classes(memberships)
    members = materialize(members)
    turned = pairs.unionByName(pairs.where("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "Consensus", "Imputations"))
    left, right = members.select(F.col("id").alias("i"), F.col("class").alias("a")), members.select(F.col("id").alias("j"), F.col("class").alias("b"))
    return left.join(turned, "a").join(right, "b").where("i < j").select("i", "j", "Consensus", "Imputations")


def imputed_cells(original: DataFrame, completed: DataFrame, variables: list[str]) -> DataFrame:
    """ID, Original_missing, Imputed_cells (average over imputations of ``completed(imputation, id, ...)``)."""
    left = completed.select("id", missing_count(variables).alias("_left")).groupBy("id").agg(F.avg("_left").alias("_left"))
    return original.select("id", missing_count(variables).alias("Original_missing")).join(left, "id", "left").select(
        F.col("id").alias("ID"), "Original_missing", (F.col("Original_missing") - F.coalesce("_left", F.col("Original_missing"))).alias("Imputed_cells")
    )
