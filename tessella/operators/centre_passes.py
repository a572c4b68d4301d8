"""Passes over the cases for centres that the driver holds: sums per cluster of all groups and starts at once.

The centres of k-means are a model of k rows per group (value of the keys) and start. Up to a checked number they
stay with the driver: a pass sends them to the tasks, a task adds up its cases by matrix arithmetic and gives one
row per cluster, and those are summed by Spark. So a round is one job that writes nothing, and starts that have
come to rest take no further part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

#: Distances that a task computes at a time.
CELLS = 2_000_000


class CentrePasses:
    """Centres of ``centres(keys, [start], cluster, center)`` and the cases they are for.

    A slot is a group and start. Slots with fewer clusters than others are filled up with centres at infinity.
    With ``copies``, a column of the cases, each counts so many times.
    """

    def __init__(self, cases: DataFrame, centres: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], size: int, copies: str | None = None):
        self.keys, self.by, self.size = keys, by, size
        kept = centres.select(*by, "cluster", "center")
        times = [F.col(copies).cast("bigint").alias("_n")] if copies else []
        self.schema, self.spark = kept.schema, centres.sparkSession
        found: dict[tuple, list] = {}
        for *name, cluster, center in kept.orderBy(*by, "cluster").collect():
            found.setdefault(tuple(name), []).append((cluster, center))
        self.slots = list(found)
        self.labels = [[c for c, _ in rows] for rows in found.values()]
        self.width = max(map(len, self.labels), default=0)
        self.values = np.full((len(found), self.width, size), np.inf)
        for i, rows in enumerate(found.values()):
            self.values[i, : len(rows)] = [x for _, x in rows]
        numbers: dict[tuple, int] = {}
        self.group = np.array([numbers.setdefault(s[: len(keys)], len(numbers)) for s in self.slots], np.int64)
        if keys and numbers:
            named = self.spark.createDataFrame([(*name, g) for name, g in numbers.items()], f"{', '.join(f'`{k}` {t}' for k, t in kept.select(*keys).dtypes)}, _g int")
            met = cases.join(F.broadcast(named), list(keys)).select("_g", "x", *times)
            parts = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            # Ranges keep a group in few tasks, and a large group in several.
            self.cases = materialize(met.repartitionByRange(parts, "_g", F.xxhash64("x")))
        else:
            self.cases = cases.select(F.lit(0).alias("_g"), "x", *times)

    def add_up(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of cases, sum of their squared distances and sum of their vectors, by slot and cluster."""
        n, ss = np.zeros((len(slots), self.width)), np.zeros((len(slots), self.width))
        sums = np.zeros((len(slots), self.width, self.size))
        if len(slots):
            parts = self.cases.mapInArrow(_sums(self.group[slots], self.values[slots]), "cell int, n bigint, ss double, s array<double>")
            total = parts.groupBy("cell").agg(F.sum("n"), F.sum("ss"), *[F.sum(F.col("s")[j]) for j in range(self.size)])
            for cell, count, squares, *vector in total.collect():
                at = divmod(cell, self.width)
                n[at], ss[at], sums[at] = count, squares, vector
        return n, ss, sums

    def settle(self, rounds: int, still: float) -> None:
        """Rounds of means, until no centre of any slot moves. A cluster without cases keeps its centre."""
        active = np.arange(len(self.slots))
        for _ in range(rounds):
            if not len(active):
                break
            n, _, sums = self.add_up(active)
            old = self.values[active]
            new = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], old)
            step = np.where(np.isfinite(old), new - np.where(np.isfinite(old), old, 0.0), 0.0)
            self.values[active] = new
            active = active[((step * step).sum(2) > still).any(1)]

    def best(self) -> None:
        """Keeps the best slot of each group: most clusters, then least sum of squares, then the first start."""
        n, ss, _ = self.add_up(np.arange(len(self.slots)))
        rank = sorted(range(len(self.slots)), key=lambda i: (self.group[i], -np.count_nonzero(n[i]), ss[i].sum(), self.slots[i]))
        kept = [i for at, i in enumerate(rank) if not at or self.group[rank[at - 1]] != self.group[i]]
        self.slots, self.labels = [self.slots[i] for i in kept], [self.labels[i] for i in kept]
        self.values, self.group = self.values[kept], self.group[kept]

    def table(self) -> DataFrame:
        rows = [(*slot, label, list(map(float, x))) for slot, labels, xs in zip(self.slots, self.labels, self.values) for label, x in zip(labels, xs)]
        return self.spark.createDataFrame(rows, self.schema)


#: Centres from which the nearest is looked for by a matrix product.
MANY_CENTRES = 32


def closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of the nearest of ``centres``, the first of equal ones. Candidates are found by a matrix
    product; where its rounding leaves more than one, all are compared by differences. Centres at infinity are never nearest."""
    real = np.flatnonzero(np.isfinite(centres).all(1))
    own = centres[real]
    size, wide = (own * own).sum(1), (x * x).sum(1)
    near = np.zeros(len(x), np.int64)
    rows = max(1, CELLS // (2 * max(1, len(own))))
    for i in range(0, len(x), rows):
        part = x[i : i + rows]
        d = part @ (-2 * own.T)
        d += size
        at = d.argmin(1)
        reach = d[np.arange(len(part)), at] + 1e-9 * (wide[i : i + rows] + size.max(initial=0.0))
        open_ = np.flatnonzero((d <= reach[:, None]).sum(1) > 1)
        if len(open_):
            at[open_] = sum((part[open_, j, None] - own[None, :, j]) ** 2 for j in range(x.shape[1])).argmin(1)
        near[i : i + rows] = real[at]
    return near, sum(((x[:, j] - centres[near, j]) ** 2 for j in range(x.shape[1])), np.zeros(len(x)))


def placed(cases: DataFrame, centres: np.ndarray, labels: list[int]) -> DataFrame:
    """``cases`` with cluster and d2 of the nearest of centres that the driver holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(labels, np.int32)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, centres.shape[1])
            near, d2 = closest(x, centres)
            columns = [*batch.columns, pa.array(names[near]), pa.array(d2)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cluster", "d2"])

    return cases.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in cases.dtypes) + ", cluster int, d2 double")


def _sums(group: np.ndarray, values: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, width, size = values.shape
        n, ss = np.zeros((slots, width), np.int64), np.zeros((slots, width))
        sums = np.zeros((slots, width, size))
        own = {g: np.flatnonzero(group == g) for g in np.unique(group)}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            of = batch.column("_g").to_numpy(zero_copy_only=False)
            times = batch.column("_n").to_numpy(zero_copy_only=False) if "_n" in batch.schema.names else None
            for g in np.unique(of):
                mine, at = x[of == g], own.get(g)
                often = times[of == g] if times is not None else None
                if at is None:
                    continue
                centres = values[at]
                rows = max(1, CELLS // (len(at) * width))
                for i in range(0, len(mine), rows):
                    part = mine[i : i + rows]
                    if width >= MANY_CENTRES:
                        found = [closest(part, c) for c in centres]
                        near, low = (np.stack([f[which] for f in found], 1) for which in (0, 1))
                    else:
                        d = np.zeros((len(part), len(at), width))
                        for j in range(size):
                            d += (part[:, j, None, None] - centres[None, :, :, j]) ** 2
                        near = d.argmin(2)
                        low = np.take_along_axis(d, near[:, :, None], 2)
                    cell = (near + width * np.arange(len(at))).ravel()
                    each = np.repeat(often[i : i + rows], len(at)) if often is not None else None

                    def count(w=None):
                        w = w if each is None else each if w is None else w * each  # noqa: B023
                        return np.bincount(cell, w, len(at) * width).reshape(len(at), width)  # noqa: B023

                    n[at] += count().astype(np.int64)
                    ss[at] += count(low.ravel())
                    for j in range(size):
                        sums[at, :, j] += count(np.repeat(part[:, j], len(at)))
        cells = np.flatnonzero(n.ravel())
        vectors = pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * size, pa.array(sums.reshape(-1, size)[cells].ravel()))
        columns = [pa.array(cells.astype(np.int32)), pa.array(n.ravel()[cells]), pa.array(ss.ravel()[cells]), vectors]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "ss", "s"])

    return run


def _moves(x: np.ndarray, at: np.ndarray, centres: np.ndarray, n: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each case the cluster that it would best go to, what the sum of squares gains, and whether that is a fall."""
    d = np.zeros((len(x), len(n)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - centres[None, :, j]) ** 2
    own = np.arange(len(x))
    leave = n[at] / np.maximum(n[at] - 1.0, 1.0) * d[own, at]
    d *= n / (n + 1.0)
    d[own, at] = np.inf
    to = d.argmin(1)
    gain = d[own, to] - leave
    return to, gain, (n[at] > 1) & (gain < -tolerance)


class Relocation:
    """Rounds of moves of the cases of ``state(id, x, cluster)`` between clusters whose centres and sizes the driver holds. A case's
    cluster follows from the one written and the rounds since, which tasks repeat; every WRITTEN rounds it is written."""

    WRITTEN = 10

    def __init__(self, state: DataFrame, rows: list[tuple[int, int, list[float]]], tolerance: float):
        self.state, self.tolerance = state, tolerance
        self.labels = np.array([r[0] for r in rows])
        self.n, self.centres = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        self.steps: list[tuple] = []

    def _replayed(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.centres.shape[1])
        at = np.searchsorted(self.labels, batch.column("cluster").to_numpy(zero_copy_only=False))
        for kind, a, b in self.steps:
            if kind == "all":
                to, _, moving = _moves(x, at, a, b, self.tolerance)
                at = np.where(moving, to, at)
            else:
                found = pc.index_in(batch.column("id"), value_set=pa.array(a, batch.schema.field("id").type)).to_numpy(zero_copy_only=False)
                hit = ~np.isnan(found)
                at[hit] = np.asarray(b)[found[hit].astype(int)]
        return x, at

    def score(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """Sizes, sums of the vectors and of the squares about the centres, by cluster after all moves that gain; numbers of
        cases that leave; and the best move of each pair of clusters (gain, id, from, to, x), in order. One pass."""
        k, size = self.centres.shape
        # Tasks get these numbers alone, not the table that this object holds.
        slim = object.__new__(Relocation)
        slim.labels, slim.n, slim.centres, slim.steps, slim.tolerance = self.labels, self.n, self.centres, list(self.steps), self.tolerance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, q, out = np.zeros(k), np.zeros((k, size)), np.zeros(k), np.zeros(k)
            best: dict[tuple[int, int], tuple] = {}
            kind = None
            for batch in batches:
                kind = batch.schema.field("id").type
                x, at = slim._replayed(batch)
                to, gain, moving = _moves(x, at, slim.centres, slim.n, slim.tolerance)
                out += np.bincount(at[moving], minlength=k)
                for pair in np.unique(at[moving] * k + to[moving]):
                    mine = np.flatnonzero(moving & (at * k + to == pair))
                    low = mine[gain[mine] == gain[mine].min()]
                    first = min((batch.column("id")[int(i)].as_py(), int(i)) for i in low)
                    move = (float(gain[low[0]]), first[0], x[first[1]].tolist())
                    key = (int(pair) // k, int(pair) % k)
                    best[key] = min(best.get(key, move), move)
                now = np.where(moving, to, at)
                apart = x - slim.centres[now]
                n += np.bincount(now, minlength=k)
                q += np.bincount(now, (apart * apart).sum(1), k)
                for j in range(size):
                    s[:, j] += np.bincount(now, apart[:, j], k)
            if kind is not None:
                pairs = list(best)
                columns = {
                    "a": [*range(k), *[a for a, _ in pairs]], "b": [-1] * k + [b for _, b in pairs], "n": [*n, *[0.0] * len(pairs)], "out": [*out, *[0.0] * len(pairs)],
                    "v": [*q, *[best[p][0] for p in pairs]], "s": [*s.tolist(), *[best[p][2] for p in pairs]],
                }
                made = {"a": pa.int32(), "b": pa.int32(), "n": pa.float64(), "out": pa.float64(), "v": pa.float64(), "s": pa.list_(pa.float64())}
                arrays = [pa.array(columns[c], t) for c, t in made.items()] + [pa.array([None] * k + [best[p][1] for p in pairs], kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*made, "id"])

        parts = self.state.mapInArrow(run, f"a int, b int, n double, out double, v double, s array<double>, id {dict(self.state.dtypes)['id']}")
        sums = parts.groupBy("a", "b").agg(F.sum("n"), F.sum("out"), F.sum("v"), F.array(*[F.sum(F.col("s")[j]) for j in range(size)]), F.min(F.struct("v", "id", "s")))
        n, s, q, out, best = np.zeros(k), np.zeros((k, size)), np.zeros(k), np.zeros(k), []
        for a, b, count, left, squares, vector, move in sums.collect():
            if b < 0:
                n[a], out[a], q[a], s[a] = count, left, squares, vector
            else:
                best.append((move["v"], move["id"], a, b, np.array(move["s"])))
        return n, s, q, out, sorted(best, key=lambda m: (m[0], m[1]))

    def take_all(self, n: np.ndarray, sums: np.ndarray) -> None:
        self.steps.append(("all", self.centres, self.n))
        self.centres, self.n = self.centres + sums / n[:, None], n
        self._write_some()

    def take(self, moves: list[tuple]) -> None:
        self.steps.append(("few", [m[1] for m in moves], [m[3] for m in moves]))
        centres, n = self.centres.copy(), self.n.copy()
        for _, _, a, b, x in moves:
            centres[a] -= (x - centres[a]) / (n[a] - 1)
            centres[b] += (x - centres[b]) / (n[b] + 1)
            n[a], n[b] = n[a] - 1, n[b] + 1
        self.centres, self.n = centres, n
        self._write_some()

    def _write_some(self) -> None:
        if len(self.steps) >= self.WRITTEN:
            self.state = self.table()
            self.steps = []

    def table(self) -> DataFrame:
        """(id, x, cluster) as it stands, written."""
        slim = object.__new__(Relocation)
        slim.labels, slim.n, slim.centres, slim.steps, slim.tolerance = self.labels, self.n, self.centres, list(self.steps), self.tolerance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, at = slim._replayed(batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(slim.labels[at]).cast(batch.schema.field("cluster").type)], names=["id", "x", "cluster"])

        return materialize(self.state.mapInArrow(run, self.state.schema))


def _uniform(h: np.ndarray, start: np.ndarray, step: int, seed: int) -> np.ndarray:
    """Numbers above 0 and below 1 from a 64-bit hash of each case, for each start (columns): a mixing of the bits of all four."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        z = h[:, None] + odd * (np.uint64(seed) * np.uint64(1_000_003) + np.uint64(step) * np.uint64(10_007) + start.astype(np.uint64)[None] + np.uint64(1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def plus_plus(cases: DataFrame, k: int, starts: int, seed: int, keys: tuple[str, ...], size: int, copies: str | None = None) -> DataFrame:
    """k-means++ seeds (keys, start, cluster, center) of all groups and starts, one pass over the cases per centre: a task
    draws, for each start, the case of smallest -ln(u) / d2 of its own, and the smallest of all tasks is taken. The
    driver holds the k centres of every start."""
    spark = cases.sparkSession
    names = [tuple(r) for r in cases.select(*keys).distinct().collect()] if keys else [()]
    times = [F.col(copies).cast("double").alias("_n")] if copies else []
    rows = cases.select(*keys, "id", "x", F.xxhash64(*keys, F.col("id").cast("string")).alias("_h"), *times)
    kinds = dict(rows.dtypes)
    key_kinds = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    if keys:
        rows = rows.join(F.broadcast(spark.createDataFrame([(*n, g) for g, n in enumerate(names)], f"{key_kinds}_g int")), list(keys))
    rows = rows.select("_g" if keys else F.lit(0).alias("_g"), "id", "x", "_h", *(["_n"] if copies else []))
    rows = materialize(rows)
    chosen = np.full((len(names), starts, k, size), np.inf)

    def draw(step: int, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        every = np.arange(1, starts + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            kind = None
            for batch in batches:
                kind = batch.schema.field("id").type
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                of, h = batch.column("_g").to_numpy(zero_copy_only=False), batch.column("_h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids = batch.column("id")
                for g in np.unique(of):
                    at = np.flatnonzero(of == g)
                    u = _uniform(h[at], every, step, seed)
                    score = -np.log(u)
                    if copies:
                        score = score / batch.column("_n").to_numpy(zero_copy_only=False)[at, None]
                    if step:
                        d = np.full((len(at), starts), np.inf)
                        for c in range(step):
                            d = np.minimum(d, sum((x[at, j, None] - centres[g, None, :, c, j]) ** 2 for j in range(size)))
                        score = np.where(d > 0, score / np.where(d > 0, d, 1.0), 1e300 * (1 + u))
                    low = score.min(0)
                    for s in range(starts):
                        for i in np.flatnonzero(score[:, s] == low[s]):
                            mine = (float(low[s]), ids[int(at[i])].as_py())
                            slot = int(g) * starts + s
                            if slot not in best or mine < best[slot][:2]:
                                best[slot] = (*mine, x[at[i]].tolist())
            if best:
                slots = list(best)
                columns = [pa.array(slots, pa.int32()), pa.array([best[s][0] for s in slots]), pa.array([best[s][1] for s in slots], kind), pa.array([best[s][2] for s in slots], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "score", "id", "x"])

        return run

    for step in range(k):
        parts = rows.mapInArrow(draw(step, chosen), f"slot int, score double, id {kinds['id']}, x array<double>")
        for slot, x in parts.groupBy("slot").agg(F.min_by("x", F.struct("score", "id"))).collect():
            chosen[slot // starts, slot % starts, step] = x
    made = [(*name, s + 1, c + 1, list(map(float, chosen[g, s, c]))) for g, name in enumerate(names) for s in range(starts) for c in range(k) if np.isfinite(chosen[g, s, c]).all()]
    return spark.createDataFrame(made, f"{key_kinds}start int, cluster int, center array<double>")
