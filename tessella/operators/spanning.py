"""Single linkage of coordinates at scale: a minimum spanning tree that compares only blocks that can matter.

Cases are put in order along a space-filling curve and cut into blocks of equal size with a bounding box each. A
round of Boruvka's algorithm asks, for every component, for its lightest edge to another one:

1. A case looks at its own block and at one or two cases of every other block. That gives each component a bound.
2. A case asks only the blocks whose box is no farther than the bound of its component and that hold other components.
3. The blocks asked give the nearest cases; many questions to one block are dealt to several tasks.

Equal cases are one point with edges of length zero, so copies do not make blocks that all must be asked. Boxes and
their cases are a table of at most MAX_BOXES rows, which is sent to the tasks; blocks grow when there are more cases.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import matrices
from tessella.operators.linkage import connected
from tessella.operators.order import ranked
from tessella.session import materialize

#: Distances for which the distance to a box bounds that to the cases inside.
BOXED = ("euclidean", "sqeuclidean", "manhattan", "maximum")
#: Cases of a block, and blocks at most: beyond, blocks hold more cases.
BLOCK_CASES, MAX_BOXES = 1000, 10_000
#: Distances that a task holds at a time.
CELLS = 2_000_000
#: Variables along which the curve runs, those of the largest variance.
CURVE_VARIABLES = 6


def curve_position(cases: DataFrame) -> Column:
    """Place of ``x`` on a Z-shaped curve through a grid over the variables of largest variance: near places are near in space."""
    size = len(cases.select("x").first()["x"])
    aggs = [f(F.col("x")[j]).alias(f"{n}{j}") for j in range(size) for n, f in (("lo", F.min), ("hi", F.max), ("v", F.var_pop))]
    row = cases.agg(*aggs).first()
    used = sorted((j for j in range(size) if row[f"hi{j}"] > row[f"lo{j}"]), key=lambda j: (-row[f"v{j}"], j))[:CURVE_VARIABLES]
    bits = min(16, 60 // max(1, len(used)))
    steps = float(2**bits - 1)
    cells = [F.floor((F.col("x")[j] - row[f"lo{j}"]) / (row[f"hi{j}"] - row[f"lo{j}"]) * steps).cast("bigint") for j in used]
    place = F.lit(0).cast("bigint")
    for bit in range(bits):
        for at, cell in enumerate(cells):
            place = place + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * len(used) + at)
    return place


def box_distance(name: str, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of each case to what is inside each box, never above the computed distance of a case inside."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0.0)
        if name == "maximum":
            np.maximum(out, gap, out=out)
        else:
            out += gap if name == "manhattan" else gap**2
    return np.sqrt(out) if name == "euclidean" else out


def _lightest(name: str, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """(c, d, i, j, cj): for each component of ``own(id, c, x)`` the first edge by (d, i, j) to a case of ``others`` in another one."""
    others = others.sort_values("id")
    y, other_c, other_id = matrices.points(others["x"]), others["c"].to_numpy(), others["id"].to_numpy()
    x, c, ids = matrices.points(own["x"]), own["c"].to_numpy(), own["id"].to_numpy()
    parts, step = [], max(1, CELLS // len(others))
    for s in range(0, len(own), step):
        d = matrices.matrix(name, x[s : s + step], y)
        d[c[s : s + step, None] == other_c[None]] = np.inf
        at = d.argmin(1)  # of equal distances the smallest id
        found = d[np.arange(len(d)), at]
        a, b = ids[s : s + step], other_id[at]
        parts.append(pd.DataFrame({"c": c[s : s + step], "d": found, "i": np.where(a < b, a, b), "j": np.where(a < b, b, a), "cj": other_c[at]})[np.isfinite(found)])
    return pd.concat(parts).sort_values(["d", "i", "j"]).drop_duplicates("c")


def _inside(name: str, known: pd.DataFrame) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        own = block[["id", "c", "x"]]
        return _lightest(name, own, pd.concat([own, known]).drop_duplicates("id"))

    return run


def _asking(name: str, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The blocks whose cases may be nearer to a case than its bound, but for its own block and those of its component alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CELLS // len(low))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s : s + step]
                c = part["c"].to_numpy()
                need = box_distance(name, matrices.points(part["x"]), low, high) <= part["bound"].to_numpy()[:, None]
                need &= ~((c[:, None] == first[None]) & (c[:, None] == last[None]))
                need[np.arange(len(part)), part["block"].to_numpy()] = False
                row, ask = np.nonzero(need)
                yield part[["id", "c", "x"]].iloc[row].assign(ask=ask)

    return run


def _answer(name: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _lightest(name, a, b) if len(a) and len(b) else pd.DataFrame(columns=["c", "d", "i", "j", "cj"])

    return run


def _joined(best: DataFrame) -> DataFrame:
    """(c, root) of components that have met by their lightest edges ``best(c, cj)``.

    Every component points to one other. As edges have a strict order, the only circles are of two that point to each
    other; the smaller becomes the root, and pointers are doubled until all are at roots.
    """
    back = best.select(F.col("c").alias("cj"), F.col("cj").alias("_back"))
    up = best.select("c", "cj").join(back, "cj")
    up = materialize(up.select("c", F.when(F.col("_back") == F.col("c"), F.least("c", "cj")).otherwise(F.col("cj")).alias("root")))
    while True:
        above = up.select(F.col("c").alias("root"), F.col("root").alias("_next"))
        further = materialize(up.join(above, "root").select("c", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")))
        up = further.select("c", "root")
        if further.where("_moved").isEmpty():
            return up


def block_tree(cases: DataFrame, name: str = "euclidean", block: int = BLOCK_CASES, trace: list[dict] | None = None) -> DataFrame:
    """(i, j, height): the tree that ``linkage.spanning_tree`` gives for all pairs of ``cases(id, x)``, without those pairs.

    ``x`` has no gaps. Edges are ordered by (height, i, j). ``trace`` gets for each round the numbers of components and of
    questions of a case to a block, and how many questions there were without bounds.
    """
    if name not in BOXED:
        raise ValueError(f"{name} has no bound by boxes: use pairs")
    spark, kind = cases.sparkSession, dict(cases.dtypes)["id"]
    rows = materialize(cases.select("id", "x"))
    heads = materialize(rows.groupBy("x").agg(F.min("id").alias("id")))
    # Edges of length zero from the first of equal cases to the others.
    copies = rows.join(heads.select(F.col("id").alias("i"), "x"), "x").where("id > i").select("i", F.col("id").alias("j"), F.lit(0.0).alias("height"))
    n = heads.count()
    parts = [materialize(copies)]
    if n < 2:
        return parts[0]
    block = max(block, math.ceil(n / MAX_BOXES))
    placed = ranked(heads.withColumn("_z", curve_position(heads)), (), ["_z", "id"], "_r")
    points = materialize(placed.select("id", "x", F.floor((F.col("_r") - 1) / block).cast("int").alias("block")))
    size = len(points.first()["x"])
    ends = points.groupBy("block").agg(F.array(*[F.min(F.col("x")[j]) for j in range(size)]).alias("lo"), F.array(*[F.max(F.col("x")[j]) for j in range(size)]).alias("hi"))
    box = ends.orderBy("block").toPandas()
    low, high = matrices.points(box["lo"]), matrices.points(box["hi"])
    label = points.select("id", F.col("id").alias("c"))
    edge = f"c {kind}, d double, i {kind}, j {kind}, cj {kind}"
    lightest = lambda df: df.groupBy("c").agg(F.min(F.struct("d", "i", "j", "cj")).alias("m")).select("c", "m.*")
    while True:
        state = materialize(points.join(label, "id"))
        # Two cases of every block, of its first and its last component.
        some = state.groupBy("block").agg(F.min(F.struct("c", "id", "x")).alias("a"), F.max(F.struct("c", "id", "x")).alias("b")).orderBy("block").toPandas()
        known = pd.DataFrame([{"id": r["id"], "c": r["c"], "x": r["x"]} for col in ("a", "b") for r in some[col]]).drop_duplicates("id")
        if known["c"].nunique() < 2:
            break
        first, last = (np.array([r["c"] for r in some[col]]) for col in ("a", "b"))

        near = materialize(lightest(state.groupBy("block").applyInPandas(_inside(name, known), edge)))

        bounded = state.join(near.select("c", F.col("d").alias("bound")), "c").select("id", "c", "x", "block", "bound")
        asks = materialize(bounded.mapInPandas(_asking(name, low, high, first, last), f"id {kind}, c {kind}, x array<double>, ask int"))
        deal = asks.groupBy("ask").agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.ceil(F.col("n") / (4 * block)).cast("int"))
        deal = F.broadcast(materialize(deal))  # a row a box at most
        left = asks.join(deal, "ask").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("s")).cast("int")).select("id", "c", "x", "ask", "salt")
        right = state.join(deal, F.col("block") == F.col("ask")).select("id", "c", "x", F.col("ask").alias("ask2"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt2"))

        told = left.groupBy("ask", "salt").cogroup(right.groupBy("ask2", "salt2")).applyInPandas(_answer(name), edge)
        best = materialize(lightest(near.unionByName(told)))
        if trace is not None:
            trace.append({"components": best.count(), "asked": asks.count(), "all": n * (len(low) - 1)})
        parts.append(best.select("i", "j", F.col("d").alias("height")).distinct())
        label = materialize(label.join(_joined(best), "c").select("id", F.col("root").alias("c")))
    return materialize(reduce(DataFrame.unionByName, parts))


def last_merges(tree: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """(stage, a, b, height, n): the last ``count - 1`` merges, at most, of single linkage on ``tree(i, j, height)``; what was
    merged before is a group named by its first case, and n counts such groups. One small task puts them in order."""
    top = materialize(tree.orderBy(F.desc("height"), F.desc("i"), F.desc("j")).limit(count - 1))
    roots = connected(ids, tree.join(top.select("i", "j"), ["i", "j"], "left_anti").select("i", "j"))
    root = materialize(roots)
    end = lambda c, name: root.select(F.col("id").alias(c), F.col("root").alias(name))
    kind = dict(ids.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        above: dict = {}
        size: dict = {}
        out = []

        def find(v):
            while v in above:
                v = above[v]
            return v

        pdf = pdf.sort_values(["height", "i", "j"])
        for one, other, height in zip(pdf["a"], pdf["b"], pdf["height"]):
            a, b = sorted((find(one), find(other)))
            above[b], size[a] = a, size.get(a, 1) + size.get(b, 1)
            out.append((len(out) + 1, a, b, height, size[a]))
        return pd.DataFrame(out, columns=["stage", "a", "b", "height", "n"])

    named = top.join(end("i", "a"), "i").join(end("j", "b"), "j")
    return named.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, f"stage bigint, a {kind}, b {kind}, height double, n bigint")
