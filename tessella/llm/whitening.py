"""Whitening of embeddings by a spectral divide and conquer on polar decompositions (QDWH).

The covariance is summed by Spark: every task adds up centred products of its rows, as whole numbers, so the sum is
exact and does not depend on partitioning. The p x p matrix goes to the driver (p is the width of the vectors, at most
``MAX_WIDTH``). There its eigenvectors are found without an eigenvalue routine: the polar factor U of A - s I has
eigenvalue +1 for eigenvalues of A above s and -1 below, so (U + I) / 2 projects onto the invariant subspace of the
larger ones; an orthogonal basis of it and of its complement splits A into two smaller matrices, and so on until every
block is a number or a multiple of the identity. The polar factor comes from dynamically weighted Halley
iterations, by QR while they are badly conditioned and by Cholesky afterwards. The components, p x 8 numbers, are
then sent to all tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize

COMPONENTS = 8
MAX_WIDTH = 4096
SCALE, SHIFT = 1024, 100_000
EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric, non-singular matrix by QDWH iterations."""
    n, eye = len(a), np.eye(len(a))
    x = a / np.linalg.norm(a)
    low = min(1.0, max(1 / np.linalg.norm(np.linalg.inv(x)), EPS))  # a lower bound of the smallest singular value
    for _ in range(30):
        if abs(low - 1) < 10 * EPS:
            low = 1.0
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.cholesky(eye + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if low == 1.0 and step <= (4 * EPS) ** (1 / 3):
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of eigenvalues above and below ``shift``; None if one is empty."""
    n = len(a)
    try:
        u = polar(a - shift * np.eye(n))
    except np.linalg.LinAlgError:  # the shift is an eigenvalue
        return None
    projector = (u + np.eye(n)) / 2
    above = round(float(np.trace(projector)))
    if not 0 < above < n:
        return None
    basis = projector @ np.random.default_rng(n).standard_normal((n, above))
    for _ in range(3):
        basis = projector @ np.linalg.qr(basis)[0]
    whole, _ = np.linalg.qr(basis, "complete")
    first, rest = whole[:, :above], whole[:, above:]
    if np.linalg.norm(rest.T @ a @ first) > 1e3 * EPS * n * np.linalg.norm(a):
        return None
    return first, rest


def spectral(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    n = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    middle = float(np.trace(a)) / n if n else 0.0
    if n <= 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * scale:
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(n)[:, order]
    # The mean of the eigenvalues lies between the least and the largest; the median of the diagonal halves better.
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    shifts = [float(np.median(np.diag(a))), middle, *[middle + s * spread for s in (1e-3, -1e-3, 0.1, -0.1, 0.3, -0.3)]]
    parts = next((p for s in shifts if (p := _halves(a, s)) is not None), None)
    if parts is None:
        raise np.linalg.LinAlgError("the spectrum could not be divided")
    values, vectors = [], []
    for basis in parts:
        e, v = spectral(basis.T @ a @ basis, scale)
        values.append(e)
        vectors.append(basis @ v)
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def clean_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>): x = floor(1024 c) + 100000 of each entry c.

    Rows whose vector is null or empty or holds a null or non-finite entry are dropped, and rows of another width than
    most (the larger width on a tie). A null key and repeated rows stay, as rows of their own. Other columns
    are ignored. An entry of 2^53 or more in size has no exact value and is an error.
    """
    values = F.transform(vector, lambda c: c.cast("double"))
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = rows.select(F.col(key).alias("vec_id"), values.alias("c")).where(F.forall("c", ok) & (F.size("c") > 0))
    whole = lambda c: F.when(F.abs(c) < float(2**53), F.floor(c * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large")).cast("bigint"))
    coded = materialize(kept.select("vec_id", F.transform("c", whole).alias("x")))
    widths = coded.groupBy(F.size("x").alias("p")).count()
    width = widths.agg(F.max(F.struct("count", "p")).alias("m")).first()["m"]
    return coded if width is None else coded.where(F.size("x") == width["p"])


def moments(coded: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums S (exact integers) and the covariance (divisor n) of ``coded(x)``.

    Two passes: sums, then products of entries less their mean rounded to a whole number. Products are added up as
    integers by every task, in as many parts as it needs to stay exact, and then by Spark.
    """
    p = coded.select(F.size("x").alias("p")).first()["p"]
    if p > MAX_WIDTH:
        raise ValueError(f"vectors of more than {MAX_WIDTH} entries")
    row = coded.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(p)]).first()
    n, sums = int(row["n"]), [int(row[f"s{i}"]) for i in range(p)]
    centre = np.array([s // n for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound = np.zeros((p, p), np.int64), 0.0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["i", "v"])

        for batch in batches:
            d = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - centre
            most = float(np.abs(d).max(initial=0)) ** 2 * len(d)
            if most >= 2**62:
                raise ValueError("vectors too far apart for exact sums")
            if bound + most >= 2**62:
                yield rows()
                total, bound = np.zeros((p, p), np.int64), 0.0
            # Doubles multiply exactly while all partial sums stay below 2^53.
            total, bound = total + ((d.T.astype(float) @ d.astype(float)).astype(np.int64) if most < 2**53 else d.T @ d), bound + most
        if bound:
            yield rows()

    parts = coded.select("x").mapInArrow(run, "i int, v array<bigint>").select("i", F.posexplode("v").alias("j", "v")).where("j >= i")
    products = np.zeros((p, p))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    for i, j, v in parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        products[i, j] = products[j, i] = (n * int(v) - rest[i] * rest[j]) / (n * n)  # whole numbers up to the division
    return n, np.array(sums, dtype=object), products


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each kept vector (see ``clean_vectors``) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``whitened`` is the centred vector on the component over the root of its eigenvalue, null for an eigenvalue of zero
    (below 1e-12 of the largest: vectors that are all equal, or span fewer dimensions). ``deviation`` is an exact
    long; it is an error if it does not fit. A single vector has nulls. An empty table gives an empty result.
    """
    coded = clean_vectors(rows, key, vector)
    schema = f"vec_id {dict(coded.dtypes)['vec_id']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if coded.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, cov = moments(coded)
    e, v = spectral(cov)
    k = min(components, len(e))
    e, v, trace = e[:k], v[:, :k], float(np.trace(cov))
    live = e > 1e-12 * max(trace, 0.0)
    root = np.where(live, np.sqrt(np.where(live, e, 1.0)), np.nan)
    base = np.array([s // n for s in sums], np.int64)
    offset = np.array([(s - n * int(b)) / n for s, b in zip(sums, base)])
    p = len(base)
    sent = rows.sparkSession.sparkContext.broadcast((base, offset, v, root))  # p * (k + 2) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, offset, v, root = sent.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            w = ((x - base) - offset) @ v / root
            flat = pa.array(w.ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("deviation"), pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * k, flat)], names=["vec_id", "deviation", "w"])

    total = F.array(*[F.lit(int(s)).cast("bigint") for s in sums])
    gap = F.zip_with("x", total, lambda a, s: (a * F.lit(n).cast("bigint") - s) * (a * F.lit(n).cast("bigint") - s))
    ready = coded.select("vec_id", "x", F.aggregate(gap, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("deviation"))
    made = materialize(ready.mapInArrow(run, f"vec_id {dict(coded.dtypes)['vec_id']}, deviation bigint, w array<double>"))
    used = [i for i in range(k) if live[i]]
    error = None
    if used:
        pairs = [(i, j) for i in used for j in used if i <= j]
        got = made.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(float(x / trace) if trace > 0 else None).cast("double") for x in e])
    return made.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        share[F.col("_at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
