"""Fuzzy clustering on unsquared distances, exponent 2: memberships by rounds of joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import matrices
from tessella.functions.hashing import key_uniform
from tessella.operators import blocks
from tessella.session import materialize


def fuzzy(pairs: DataFrame, ids: DataFrame, k: int, rounds: int = 50, tolerance: float = 1e-9, seed: int = 2026) -> tuple[DataFrame, list[float]]:
    """(memberships(id, cluster, u), objective by round).

    Minimises the sum over clusters of sum_ij u_i^2 u_j^2 d_ij / (2 sum_j u_j^2). With the others held fixed, a case's memberships
    are proportional to the inverse of its a_v = sum_j u_j^2 d_ij / S_v - sum_ij u_i^2 u_j^2 d_ij / (2 S_v^2), S_v = sum_j u_j^2.
    Starts from memberships that lean to one cluster by hash. k must not exceed n / 2 - 1.
    """
    n = ids.count()
    if k > n / 2 - 1:
        raise ValueError("fuzzy clustering needs k of at most n / 2 - 1")
    both = materialize(pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")))
    # Spread starts: the kth lean follows the distance to k far-apart cases.
    far = [both.groupBy("i").agg(F.sum("d").alias("s")).agg(F.min(F.struct("s", "i")).alias("m")).first()["m"]["i"]]
    while len(far) < k:
        reach = both.where(F.col("j").isin(far)).groupBy("i").agg(F.min("d").alias("s")).where(~F.col("i").isin(far))
        far.append(reach.agg(F.min(F.struct(-F.col("s"), "i")).alias("m")).first()["m"]["i"])
    leads = both.where(F.col("j").isin(far)).unionByName(ids.where(F.col("id").isin(far)).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d")))
    number = F.create_map(*[F.lit(x) for c, v in enumerate(far) for x in (v, c + 1)])
    start = leads.select(F.col("i").alias("id"), number[F.col("j")].alias("cluster"), (1 / (F.col("d") + 1e-3 + 1e-6 * key_uniform(str(seed), F.col("i"), F.col("j")))).alias("w"))
    state = materialize(_shares(start))
    trace: list[float] = []
    for _ in range(rounds):
        squares = state.select("id", "cluster", (F.col("u") * F.col("u")).alias("q"))
        sums = squares.groupBy("cluster").agg(F.sum("q").alias("S"))
        pull = materialize(both.join(squares.withColumnRenamed("id", "j"), "j").groupBy("i", "cluster").agg(F.sum(F.col("q") * F.col("d")).alias("p")))
        spread = pull.join(squares.withColumnRenamed("id", "i"), ["i", "cluster"]).groupBy("cluster").agg(F.sum(F.col("q") * F.col("p")).alias("T"))
        per = F.broadcast(materialize(sums.join(spread, "cluster")))
        trace.append(float(per.agg(F.sum(F.col("T") / (2 * F.col("S")))).first()[0]))
        if len(trace) > 1 and abs(trace[-2] - trace[-1]) <= tolerance * max(abs(trace[-1]), 1.0):
            break
        a = F.col("p") / F.col("S") - F.col("T") / (2 * F.col("S") * F.col("S"))
        state = materialize(_shares(pull.join(per, "cluster").select(F.col("i").alias("id"), "cluster", (1 / F.greatest(a, F.lit(1e-12))).alias("w"))))
    return state, trace


def block_fuzzy(cases: DataFrame, name: str, k: int, rounds: int = 50, tolerance: float = 1e-9, seed: int = 2026) -> tuple[DataFrame, list[float]]:
    """``fuzzy`` of all pairs of ``cases(id, x)`` under the distance ``name``, without the pairs: in a round a pass over pairs of
    blocks adds up, for each case, the others' distances by their squared memberships."""
    rows = materialize(cases.select("id", "x"))
    n, kind = rows.count(), dict(rows.dtypes)["id"]
    if k > n / 2 - 1:
        raise ValueError("fuzzy clustering needs k of at most n / 2 - 1")
    names = [f"u{c}" for c in range(k)]

    def pulls(weighted: DataFrame, columns: list[str]) -> DataFrame:
        """(id, p0, ...): sums of distances to all cases, by each of the columns."""

        def meet(a: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(a["id"]), len(columns)))
            for b in others:
                total += matrices.matrix(name, a["x"], b["x"]) @ np.stack([b[c] for c in columns], 1)
            yield blocks.batch({"id": a["id"], **{f"p{j}": total[:, j] for j in range(len(columns))}})

        parts = blocks.crossed(blocks.dealt(weighted.select("id", *columns, "x"), n), meet, f"id {kind}, " + ", ".join(f"p{j} double" for j in range(len(columns))))
        return parts.groupBy("id").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(len(columns))])

    def led(far: list[tuple]) -> DataFrame:
        """(id, d): distances to the cases of ``far``."""
        centres = np.array([x for _, x in far])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = matrices.matrix(name, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), centres)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(d))], names=["id", "d"])

        return rows.mapInArrow(run, f"id {kind}, d array<double>")

    vector = lambda i: (i, [float(v) for v in rows.where(F.col("id") == i).first()["x"]])
    ones = rows.withColumn("one", F.lit(1.0))
    far = [vector(pulls(ones, ["one"]).agg(F.min(F.struct("p0", "id")).alias("m")).first()["m"]["id"])]
    while len(far) < k:
        reach = led(far).where(~F.col("id").isin([i for i, _ in far]))
        far.append(vector(reach.agg(F.min(F.struct(-F.array_min("d"), "id")).alias("m")).first()["m"]["id"]))
    lean = [1 / (F.col("d")[c] + 1e-3 + 1e-6 * key_uniform(str(seed), F.col("id"), F.lit(far[c][0]))) for c in range(k)]
    state = materialize(rows.join(_even(led(far), lean), "id"))
    trace: list[float] = []
    for _ in range(rounds):
        squares = state.select("id", "x", *[(F.col(u) * F.col(u)).alias(u) for u in names])
        met = materialize(squares.join(pulls(squares, names), "id"))
        row = met.agg(*[F.sum(u).alias(f"S{c}") for c, u in enumerate(names)], *[F.sum(F.col(u) * F.col(f"p{c}")).alias(f"T{c}") for c, u in enumerate(names)]).first()
        trace.append(float(sum(row[f"T{c}"] / (2 * row[f"S{c}"]) for c in range(k))))
        if len(trace) > 1 and abs(trace[-2] - trace[-1]) <= tolerance * max(abs(trace[-1]), 1.0):
            break
        pull = [F.col(f"p{c}") / row[f"S{c}"] - row[f"T{c}"] / (2 * row[f"S{c}"] ** 2) for c in range(k)]
        state = materialize(met.select("id", "x").join(_even(met, [1 / F.greatest(a, F.lit(1e-12)) for a in pull]), "id"))
    long = F.explode(F.array(*[F.struct(F.lit(c + 1).alias("cluster"), F.col(u).alias("u")) for c, u in enumerate(names)])).alias("r")
    return state.select("id", long).select("id", "r.*"), trace


def _even(rows: DataFrame, weights: list) -> DataFrame:
    """(id, u0, ...): the weights of a case by their sum."""
    made = rows.select("id", *[w.alias(f"u{c}") for c, w in enumerate(weights)])
    total = sum((F.col(f"u{c}") for c in range(1, len(weights))), F.col("u0"))
    return made.select("id", *[(F.col(f"u{c}") / total).alias(f"u{c}") for c in range(len(weights))])


def _shares(weights: DataFrame) -> DataFrame:
    total = weights.groupBy("id").agg(F.sum("w").alias("_t"))
    return weights.join(total, "id").select("id", "cluster", (F.col("w") / F.col("_t")).alias("u"))


def hard(memberships: DataFrame, k: int | None = None) -> DataFrame:
    """(id, cluster) of largest membership, lower cluster on ties; ValueError if fewer than k clusters are used."""
    labels = memberships.groupBy("id").agg(F.min_by("cluster", F.struct(-F.round("u", 12), "cluster")).alias("cluster"))
    if k is not None and labels.select("cluster").distinct().count() < k:
        raise ValueError(f"fewer than {k} clusters have cases")
    return labels
