"""Hierarchies: agglomerative linkages and DIANA, and cutting them.

Four ways, by size and linkage:

* Single linkage is a minimum spanning tree, found by Boruvka rounds on pairs(i, j, d): every component takes
  its lightest outgoing edge, components are merged, and the number of components at least halves.
* Reducible linkages (complete, average, mcquitty, Ward on squared distances, flexible with beta <= 0) merge
  all mutual nearest neighbours of a round at once; the distances of the merged groups follow from a
  join and the Lance-Williams rule.
* The same merges from the cases' coordinates (``block_merges``, ``block_spanning_tree``): distances of groups follow from
  those of their members, which a pass over pairs of blocks works out anew in each round, so that no pair is written.
* Anything at scale runs on representatives: k-means micro-clusters with their sizes, at most 2,000, whose hierarchy is
  made by the Lance-Williams rule in one small task per group of cases, and is handed back to the cases by
  a join. The other linkages (centroid, median, flexible with beta > 0, DIANA) merge or split strictly
  one step at a time and always take this way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import matrices
from tessella.operators import blocks, kmeans
from tessella.session import materialize

REDUCIBLE = ("complete", "average", "mcquitty", "ward.D", "ward.D2", "flexible")
TREES = (*REDUCIBLE, "single", "centroid", "median", "diana")
SQUARED = ("ward.D2", "centroid", "median")
MAX_REPRESENTATIVES = 2000
#: Groups left at which the rounds stop and one small task does the rest; the same for rounds over blocks, which go on
#: slowly in many dimensions, where few groups are each other's nearest: a matrix of 128 MB.
LAST_GROUPS, LAST_OF_BLOCKS = 256, 4000


def _update(method: str, beta: float):
    """Distance of a merged group (a, b) to c from those of its parts, as an expression of d_ac, d_bc, d_ab and sizes."""
    if method == "single":
        return lambda ac, bc, ab, na, nb, nc: F.least(ac, bc)
    if method == "complete":
        return lambda ac, bc, ab, na, nb, nc: F.greatest(ac, bc)
    if method == "average":
        return lambda ac, bc, ab, na, nb, nc: (na * ac + nb * bc) / (na + nb)
    if method == "mcquitty":
        return lambda ac, bc, ab, na, nb, nc: (ac + bc) / 2
    if method in ("ward.D", "ward.D2"):
        return lambda ac, bc, ab, na, nb, nc: ((na + nc) * ac + (nb + nc) * bc - nc * ab) / (na + nb + nc)
    if method == "flexible":
        return lambda ac, bc, ab, na, nb, nc: (1 - beta) / 2 * (ac + bc) + beta * ab
    raise ValueError(f"unknown linkage {method!r}")


def mutual_merges(pairs: DataFrame, ids: DataFrame, method: str, beta: float = -0.25, last: int = LAST_GROUPS) -> DataFrame:
    """(a, b, height, n): merges of groups named by their smallest id; a < b, the merged group keeps the name a.

    ``pairs(i, j, d)`` are all pairs of ``ids(id)``. Ward D2 works on squared distances and gives their roots as
    heights. Ties go to the smaller names, so the result does not depend on partitioning. At ``last`` groups
    or fewer the remaining merges are made in one task, from at most last * (last - 1) / 2 distances.
    """
    if method not in (*REDUCIBLE, "single") or (method == "flexible" and beta > 0):
        raise ValueError(f"{method} does not merge in rounds")
    squared = method == "ward.D2"
    rule = _update(method, beta)
    edges = materialize(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("d") * F.col("d") if squared else F.col("d")).alias("d")))
    sizes = materialize(ids.select("id", F.lit(1.0).alias("n")))
    made: DataFrame | None = None
    while (groups := sizes.count()) > 1:
        if groups <= last:
            rest = _last_merges(edges, sizes, method, beta)
            return rest if made is None else made.unionByName(rest)
        both = edges.select("a", "b", "d").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        nearest = both.groupBy("a").agg(F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
        other = nearest.select(F.col("a").alias("b"), F.col("b").alias("a"))
        mutual = nearest.join(other, ["a", "b"]).where("a < b")
        merged = mutual.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        step = materialize(merged.select("a", "b", (F.sqrt("d") if squared else F.col("d")).alias("height"), (F.col("na") + F.col("nb")).alias("n"), F.col("d").alias("dab"), "na", "nb"))
        made = step.select("a", "b", "height", "n") if made is None else made.unionByName(step.select("a", "b", "height", "n"))
        names = step.select(F.col("b").alias("id"), F.col("a").alias("to"))
        grown = materialize(sizes.join(names, "id", "left_anti").join(step.select(F.col("a").alias("id"), F.col("n").alias("_m")), "id", "left").select("id", F.coalesce("_m", "n").alias("n")))
        apart = edges.join(step.select("a", "b"), ["a", "b"], "left_anti")
        both = apart.select("a", "b", "d").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        # First one end of every edge is merged, beside the old groups, then the other, beside the new ones.
        half = _merge_end(both, step, sizes, rule)
        edges = materialize(_merge_end(half, step, grown, rule).where("a < b"))
        sizes = grown
    return made if made is not None else pairs.sparkSession.createDataFrame([], "a bigint, b bigint, height double, n double")


def _last_merges(edges: DataFrame, sizes: DataFrame, method: str, beta: float) -> DataFrame:
    rows = edges.select("a", "b", "d").unionByName(sizes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("n").alias("d")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["a"] == pdf["b"]].sort_values("a")
        names, n = own["a"].to_numpy(), own["d"].to_numpy(float)
        between = pdf[pdf["a"] != pdf["b"]]
        i, j = np.searchsorted(names, between["a"]), np.searchsorted(names, between["b"])
        d = np.full((len(names), len(names)), np.inf)
        d[i, j] = d[j, i] = between["d"]
        size, out = n.copy(), []
        for a, b, h in lance_williams(d, n, method, beta):
            size[a] += size[b]
            out.append((names[a], names[b], h, size[a]))
        return pd.DataFrame(out, columns=["a", "b", "height", "n"])

    return rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "a bigint, b bigint, height double, n double")


def _merge_end(edges: DataFrame, step: DataFrame, sizes: DataFrame, rule) -> DataFrame:
    """Directed edges (a, b, d) with the merges of ``step`` applied to the end a by the Lance-Williams rule, turned
    round to (b, merged a). ``sizes`` are those of the ends b."""
    member = step.select(F.col("a").alias("g"), F.col("a").alias("m")).unionByName(step.select(F.col("a").alias("g"), F.col("b").alias("m")))
    tagged = edges.join(member, F.col("a") == F.col("m"), "left").withColumn("g", F.coalesce("g", "a"))
    grouped = tagged.groupBy("g", "b").agg(F.min(F.struct("a", "d")).alias("lo"), F.max(F.struct("a", "d")).alias("hi"), F.count(F.lit(1)).alias("k"))
    met = grouped.join(step.select(F.col("a").alias("g"), "dab", "na", "nb"), "g", "left").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nc")), "b", "left")
    d = F.when(F.col("k") == 2, rule(F.col("lo.d"), F.col("hi.d"), F.col("dab"), F.col("na"), F.col("nb"), F.col("nc"))).otherwise(F.col("lo.d"))
    return met.select(F.col("b").alias("a"), F.col("g").alias("b"), d.alias("d"))


def spanning_tree(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Single linkage: (i, j, height) of the minimum spanning tree; edges are ordered by (d, i, j), so equal
    distances close no cycle."""
    edges = materialize(pairs.select("i", "j", "d"))
    label = materialize(ids.select("id", F.col("id").alias("c")))
    tree: DataFrame | None = None
    while True:
        a, b = label.select(F.col("id").alias("i"), F.col("c").alias("ci")), label.select(F.col("id").alias("j"), F.col("c").alias("cj"))
        out = edges.join(a, "i").join(b, "j").where("ci <> cj")
        ends = out.select("ci", F.struct("d", "i", "j").alias("e"), "cj").unionByName(out.select(F.col("cj").alias("ci"), F.struct("d", "i", "j").alias("e"), F.col("ci").alias("cj")))
        best = materialize(ends.groupBy("ci").agg(F.min(F.struct("e", "cj")).alias("m")).select("ci", F.col("m.cj").alias("cj"), F.col("m.e").alias("e")))
        if best.isEmpty():
            break
        new = best.select("e.i", "e.j", F.col("e.d").alias("height")).distinct()
        tree = new if tree is None else tree.unionByName(new)
        roots = connected(label.select(F.col("c").alias("id")).distinct(), best.select(F.col("ci").alias("i"), F.col("cj").alias("j")))
        label = materialize(label.join(roots.select(F.col("id").alias("c"), F.col("root")), "c").select("id", F.col("root").alias("c")))
    return materialize(tree) if tree is not None else edges.limit(0).withColumnRenamed("d", "height")


def _starts(g: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, g[1:] != g[:-1]])


def _coarse(d: np.ndarray) -> np.ndarray:
    """Without the last bits, which depend on the order of a sum: equal distances are equal from both sides."""
    return ((np.ascontiguousarray(d).view(np.int64) + 128) & ~np.int64(255)).view(float)


def _between(name: str, method: str) -> Callable[[blocks.Block, blocks.Block], np.ndarray]:
    """Distances of the groups of two blocks of members(g, id, x, u, h, n, t), sorted by g, from those of the members."""

    def far(a: blocks.Block, b: blocks.Block) -> np.ndarray:
        d = matrices.matrix(name, a["x"], b["x"])
        p, q = _starts(a["g"]), _starts(b["g"])
        if method == "complete":
            return _coarse(np.maximum.reduceat(np.maximum.reduceat(d, p, 0), q, 1))
        if method == "flexible" and (len(i := np.flatnonzero(a["h"] >= 0)) or (b["h"] >= 0).any()):
            j = np.flatnonzero(b["h"] >= 0)
            d[i] = np.maximum(a["h"][i, None], b["h"][None])
            d[:, j] = np.maximum(a["h"][:, None], b["h"][None, j])
        d *= a["u"][:, None]
        d *= b["u"][None]
        d = np.add.reduceat(np.add.reduceat(d, p, 0), q, 1)
        if method in ("ward.D", "ward.D2"):
            na, nb = a["n"][p, None], b["n"][None, q]
            d = 2 * na * nb / (na + nb) * np.maximum(d - a["t"][p, None] / 2 - b["t"][None, q] / 2, 0.0)
        return _coarse(d)

    return far


def _nearest_groups(members: DataFrame, rows: int, name: str, method: str) -> DataFrame:
    """(a, b, d): the nearest other group of each group, the smaller name on ties."""
    far = _between(name, method)

    def meet(a: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        own = a["g"][_starts(a["g"])]
        best, near = np.full(len(own), np.inf), np.full(len(own), -1, np.int64)
        for b in others:
            d, names = far(a, b), b["g"][_starts(b["g"])]
            if a["block"] == b["block"]:
                np.fill_diagonal(d, np.inf)
            at = d.argmin(1)
            low, to = d[np.arange(len(own)), at], names[at]
            better = (low < best) | ((low == best) & np.isfinite(low) & (to < near))
            best[better], near[better] = low[better], to[better]
        some = near >= 0
        yield blocks.batch({"a": own[some], "b": near[some], "d": best[some]})

    parts = blocks.crossed(blocks.dealt(members, rows, ("g", "id"), "g"), meet, "a bigint, b bigint, d double")
    return parts.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))


def block_merges(cases: DataFrame, name: str, method: str, beta: float = -0.25, last: int = LAST_OF_BLOCKS) -> DataFrame:
    """``mutual_merges`` of all pairs of ``cases(id, x)`` under the distance ``name``, without the pairs.

    Distances between groups are those of their members: the largest, or sums with weights u (average: 1 / n, mcquitty: a half for
    each merge), Ward's from the means between and within two groups (t). Under flexible linkage the distance of two groups depends
    on the order in which both were formed, by height; there each merge is a further member of weight beta, at its height h from all
    that is formed earlier, and (1 - beta) / 2 is taken of the others. So a round needs no distances of the one before, and gives
    the merges that are made one at a time. Equal cases are merged first. At ``last`` groups one task makes the rest.
    """
    if method not in REDUCIBLE or (method == "flexible" and beta > 0):
        raise ValueError(f"{method} does not merge in rounds")
    squared, share = method == "ward.D2", (1 - beta) / 2
    metric = "sqeuclidean" if squared and name == "euclidean" else name
    if squared and metric != "sqeuclidean":
        raise ValueError("Ward's linkage of squared distances needs Euclidean distance")
    apart = F.col("id") if name not in ("euclidean", "sqeuclidean", "manhattan", "maximum", "cosine") else F.when(F.exists("x", lambda v: v != 0), F.lit(None)).otherwise(F.col("id")) if name == "cosine" else F.lit(None)
    alike = materialize(cases.select("id", "x").groupBy("x", apart.cast("bigint").alias("_apart")).agg(F.array_sort(F.collect_list(F.col("id").cast("bigint"))).alias("ids")))
    made = alike.where(F.size("ids") > 1).select(F.col("ids")[0].alias("a"), F.posexplode(F.slice("ids", 2, F.size("ids"))).alias("at", "b")).select("a", "b", F.lit(0.0).alias("height"), (F.col("at") + 2.0).alias("n"))
    # Weight of m equal cases, merged one by one; under flexible linkage their merges, at height 0, have the rest.
    m = F.size("ids").cast("double")
    real = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("ids"))), F.lit(1.0), lambda w, i: F.when(i <= F.size("ids"), share * (w + 1.0)).otherwise(w)) if method == "flexible" else F.lit(1.0)
    members = alike.select(F.col("ids")[0].alias("g"), F.col("ids")[0].alias("id"), "x", real.alias("u"), F.lit(-1.0).alias("h"), m.alias("n"), F.lit(0.0).alias("t"))
    if method == "flexible":
        members = materialize(members)
        members = members.unionByName(members.where("n > 1").withColumns({"h": F.lit(0.0), "u": 1.0 - F.col("u")}))
    members = materialize(members)
    rows, groups, steps = members.count(), alike.count(), 0
    while groups > last:
        nearest = materialize(_nearest_groups(members, rows, metric, method))
        mutual = nearest.alias("p").join(nearest.alias("q"), (F.col("p.a") == F.col("q.b")) & (F.col("p.b") == F.col("q.a"))).where("p.a < p.b").select("p.a", "p.b", F.least("p.d", "q.d").alias("d"))
        if mutual.isEmpty():  # distances that differ in their last bits only
            mutual = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").orderBy("d", "a", "b").limit(1)
        sizes = members.groupBy("g").agg(F.first("n").alias("n"), F.first("t").alias("t"))
        ends = mutual.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb")), "b")
        both, product = F.col("na") + F.col("nb"), F.col("na") * F.col("nb")
        mean = F.col("d") * both / (2 * product) + (F.col("ta") + F.col("tb")) / 2
        within = (F.col("na") * F.col("na") * F.col("ta") + F.col("nb") * F.col("nb") * F.col("tb") + 2 * product * mean) / (both * both)
        step = materialize(ends.select("a", "b", "d", both.alias("n"), within.alias("t")))
        merged = step.select("a", "b", (F.sqrt("d") if squared else F.col("d")).alias("height"), "n")
        made = made.unionByName(merged)
        found, steps = step.count(), steps + 1
        groups -= found
        named = step.select(F.explode(F.array("a", "b")).alias("g"), F.col("a").alias("to"), F.col("n").alias("_n"), F.col("t").alias("_t"))
        part = {"complete": F.lit(1.0), "mcquitty": F.lit(0.5), "flexible": F.lit(share)}.get(method, F.col("n") / F.col("_n"))
        grown = members.join(named, "g", "left").select(
            F.coalesce("to", "g").alias("g"), "id", "x", F.when(F.col("to").isNotNull(), F.col("u") * part).otherwise(F.col("u")).alias("u"), "h", F.coalesce("_n", "n").alias("n"), F.coalesce("_t", "t").alias("t"))
        if method == "flexible":
            zeros = F.array_repeat(F.lit(0.0), kmeans.dimensions(members))
            grown = grown.unionByName(step.select(F.col("a").alias("g"), F.lit(-steps).cast("bigint").alias("id"), zeros.alias("x"), F.lit(float(beta)).alias("u"), F.col("d").alias("h"), "n", F.lit(0.0).alias("t")))
            rows += found
        members = materialize(grown)
    return made.unionByName(_rest(members, rows, metric, method, beta))


def _rest(members: DataFrame, rows: int, name: str, method: str, beta: float) -> DataFrame:
    """The merges of at most a few thousand groups, in one task, from the distances that pairs of blocks give."""
    far = _between(name, method)

    def meet(a: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        p = _starts(a["g"])
        for b in others:
            if a["block"] <= b["block"]:
                formed = np.flatnonzero(a["h"] >= 0) if a["block"] == b["block"] else np.empty(0, np.int64)
                yield blocks.batch({
                    "a": [a["g"][p]], "b": [b["g"][_starts(b["g"])]], "n": [a["n"][p]], "d": [far(a, b).tobytes()], "own": [a["block"] == b["block"]],
                    "g": [a["g"][formed]], "h": [a["h"][formed]], "u": [a["u"][formed]],
                })

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own"]]
        names, n = np.concatenate(own["a"].to_list()), np.concatenate(own["n"].to_list())
        order = np.argsort(names)
        names, n = names[order], n[order].astype(float)
        d = np.zeros((len(names), len(names)))
        for a, b, bytes_ in zip(pdf["a"], pdf["b"], pdf["d"]):
            i, j = np.searchsorted(names, a), np.searchsorted(names, b)
            part = np.frombuffer(bytes_).reshape(len(i), len(j))
            d[np.ix_(i, j)] = part
            d[np.ix_(j, i)] = part.T
        late = None
        if method == "flexible":
            late = _formed_later(len(names), np.searchsorted(names, np.concatenate(own["g"].to_list())), np.concatenate(own["h"].to_list()), np.concatenate(own["u"].to_list()), (1 - beta) / 2)
        size, out = n.copy(), []
        for a, b, h in lance_williams(d, n, method, beta, late):
            size[a] += size[b]
            out.append((names[a], names[b], h, size[a]))
        return pd.DataFrame(out, columns=["a", "b", "height", "n"])

    tables = blocks.crossed(blocks.dealt(members, rows, ("g", "id"), "g"), meet, "a array<bigint>, b array<bigint>, n array<double>, d binary, own boolean, g array<bigint>, h array<double>, u array<double>")
    return materialize(tables.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "a bigint, b bigint, height double, n double"))


def _formed_later(size: int, group: np.ndarray, height: np.ndarray, weight: np.ndarray, share: float) -> Callable[[int, int, float], np.ndarray]:
    """For ``lance_williams`` under flexible linkage of groups that have merges (group, height, weight) above those to come: the
    height at which a merge of a and b counts for each group, which is above its own where the group is formed later."""
    group, weight = group.copy(), weight.copy()

    def counted(a: int, b: int, h: float) -> np.ndarray:
        above = height > h
        out = np.full(size, h) + np.bincount(group[above], weight[above] * (height[above] - h), size)
        mine = (group == a) | (group == b)
        weight[mine] *= share
        group[group == b] = a
        return out

    return counted


def block_spanning_tree(cases: DataFrame, name: str) -> DataFrame:
    """``spanning_tree`` of all pairs of ``cases(id, x)`` under the distance ``name``, without the pairs."""
    label = materialize(cases.select("id", F.col("id").alias("c")))
    rows = label.count()
    tree: DataFrame | None = None

    def meet(a: blocks.Block, others: Iterator[blocks.Block]) -> Iterator[pa.RecordBatch]:
        n, ids = len(a["id"]), a["id"]
        best, near, to = np.full(n, np.inf), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for b in others:
            d = _coarse(matrices.matrix(name, a["x"], b["x"]))
            d[a["c"][:, None] == b["c"][None]] = np.inf
            at = d.argmin(1)  # blocks are sorted by id: the first is the smallest
            low, other = d[np.arange(n), at], b["id"][at]
            better = np.isfinite(low) & ((low < best) | ((low == best) & (other < near)))
            best[better], near[better], to[better] = low[better], other[better], b["c"][at][better]
        some = near >= 0
        yield blocks.batch({"ci": a["c"][some], "cj": to[some], "d": best[some], "i": np.minimum(ids, near)[some], "j": np.maximum(ids, near)[some]})

    while True:
        packs = blocks.dealt(cases.select("id", "x").join(label, "id"), rows)
        parts = blocks.crossed(packs, meet, "ci bigint, cj bigint, d double, i bigint, j bigint")
        best = materialize(parts.groupBy("ci").agg(F.min(F.struct("d", "i", "j", "cj")).alias("m")).select("ci", "m.*"))
        if best.isEmpty():
            break
        new = best.groupBy("i", "j").agg(F.min("d").alias("height"))
        tree = new if tree is None else tree.unionByName(new)
        roots = connected(label.select(F.col("c").alias("id")).distinct(), best.select(F.col("ci").alias("i"), F.col("cj").alias("j")))
        label = materialize(label.join(roots.select(F.col("id").alias("c"), "root"), "c").select("id", F.col("root").alias("c")))
    return materialize(tree) if tree is not None else cases.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("height")).limit(0)


def connected(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): smallest id of each connected component, by minimum labels and pointer jumping."""
    both = materialize(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    label = materialize(ids.select("id", F.col("id").alias("root")))
    while True:
        near = both.join(label.select(F.col("id").alias("j"), F.col("root").alias("r")), "j").groupBy("i").agg(F.min("r").alias("r"))
        lower = label.join(near, label["id"] == near["i"], "left").select("id", F.least(F.col("root"), F.coalesce("r", "root")).alias("root"))
        hop = label.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        new = materialize(lower.join(hop, "root", "left").select("id", F.least("root", "_next").alias("root")))
        changed = new.join(label.select("id", F.col("root").alias("_was")), "id").where("root <> _was")
        label = new
        if changed.isEmpty():
            return label


def cut(ids: DataFrame, merges: DataFrame, k: int, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(id, cluster): a hierarchy cut at k by undoing its k - 1 highest merges; clusters are numbered by their
    first case. One tree serves every k."""
    n = merges.count() + 1
    order = [F.desc("height"), F.desc(ends[0]), F.desc(ends[1])]
    top = merges.orderBy(*order).limit(k - 1)
    kept = merges.join(top.select(*ends), list(ends), "left_anti") if k > 1 else merges
    roots = connected(ids, kept.select(F.col(ends[0]).alias("i"), F.col(ends[1]).alias("j")))
    if n < k:
        raise ValueError(f"{n} cases cannot form {k} clusters")
    numbers = roots.select("root").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("root")))
    return roots.join(F.broadcast(numbers), "root").select("id", "cluster")


def initial_distances(x: np.ndarray, weights: np.ndarray, method: str) -> np.ndarray:
    """Distances of weighted points as the linkage starts from them."""
    d = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)
    d = d if method in SQUARED else np.sqrt(d)
    if method in ("ward.D2", "ward.D"):  # groups of cases at their centres: the merge costs their sizes
        d = d * 2 * np.multiply.outer(weights, weights) / np.add.outer(weights, weights)
    return d


def lance_williams(d: np.ndarray, weights: np.ndarray, method: str, beta: float = -0.25, late: Callable[[int, int, float], np.ndarray] | None = None) -> list[tuple[int, int, float]]:
    """(a, b, height) merges of up to a few thousand groups from their distances (squared for the methods in
    SQUARED), a keeping its place. Always the closest two groups are merged, of equal ones the first.

    Each row keeps its closest later group, so a step costs a few rows, not the whole matrix. ``late`` gives the height of a merge
    as it counts for each group, where that is not the height itself (flexible linkage).
    """
    d, n = d.astype(float), weights.astype(float)
    size, out = len(d), []
    np.fill_diagonal(d, np.inf)
    near, best = np.zeros(size, np.int64), np.full(size, np.inf)

    def look(i: int) -> None:
        if i + 1 < size:
            near[i] = i + 1 + int(np.argmin(d[i, i + 1 :]))
            best[i] = d[i, near[i]]

    for i in range(size):
        look(i)
    for _ in range(size - 1):
        a = int(np.argmin(best))
        b = int(near[a])
        ab, na, nb, ac, bc = d[a, b], n[a], n[b], d[a], d[b]
        if method == "single":
            new = np.minimum(ac, bc)
        elif method == "complete":
            new = np.maximum(ac, bc)
        elif method == "average":
            new = (na * ac + nb * bc) / (na + nb)
        elif method == "mcquitty":
            new = (ac + bc) / 2
        elif method in ("ward.D", "ward.D2"):
            new = ((na + n) * ac + (nb + n) * bc - n * ab) / (na + nb + n)
        elif method == "centroid":
            new = (na * ac + nb * bc) / (na + nb) - na * nb * ab / (na + nb) ** 2
        elif method == "median":
            new = (ac + bc) / 2 - ab / 4
        else:
            new = (1 - beta) / 2 * (ac + bc) + beta * (ab if late is None else late(a, b, ab))
        out.append((a, b, float(np.sqrt(ab) if method == "ward.D2" else ab)))
        new = np.where(np.isinf(ac) | np.isinf(bc), np.inf, new)  # groups that are gone, a and b themselves
        n[a] = na + nb
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        best[b] = np.inf
        closer = (new[:a] < best[:a]) | ((new[:a] == best[:a]) & (a < near[:a]))
        again = np.flatnonzero(((near[:b] == a) | (near[:b] == b)) & np.isfinite(best[:b]))
        near[:a][closer] = a
        best[:a][closer] = new[:a][closer]
        for i in again:
            look(int(i))
        look(a)
    return out


def cut_merges(size: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels of ``size`` groups after all merges but the last k - 1: the place of each label's first group."""
    label = np.arange(size)
    for a, b, _ in merges[: max(0, size - k)]:
        label[label == label[b]] = label[a]
    return label


def diana(d: np.ndarray, weights: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """Labels of weighted groups for each k, from their distances: the widest group is split by a splinter group, which
    takes a member as long as one is nearer to it, on average, than to the rest. The sums of distances to the rest and
    to the splinter group follow each move by one column."""
    label, out = np.zeros(len(d), int), {}
    width = {0: float(d.max(initial=0.0))}
    for k in range(1, max(ks) + 1):
        if k > 1:
            group = np.flatnonzero(label == max(width, key=lambda c: (width[c], -c)))
            sub, w = d[np.ix_(group, group)], weights[group]
            inside, rest, away, mass = np.ones(len(group), bool), sub @ w, np.zeros(len(group)), 0.0
            while inside.sum() > 1:
                own = rest / np.maximum(w[inside].sum() - np.where(inside, w, 0), 1e-12)
                gain = np.where(inside, own - (away / mass if mass else 0.0), -np.inf)
                best = int(np.argmax(gain))
                if mass and gain[best] <= 0:
                    break
                inside[best], mass = False, mass + w[best]
                rest, away = rest - sub[:, best] * w[best], away + sub[:, best] * w[best]
            old = label[group[0]]
            label[group[~inside]] = k - 1
            for c in (old, k - 1):
                members = np.flatnonzero(label == c)
                width[c] = float(d[np.ix_(members, members)].max()) if len(members) > 1 else -1.0
        if k in ks:
            out[k] = label.copy()
    return out


def diana_merges(d: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """The splits of ``diana`` down to single points, as merges in order of height: of equal ones the later split first."""
    n = len(d)
    labels = diana(d, weights, list(range(1, n + 1)))
    out = []
    for k in range(2, n + 1):
        before, after = labels[k - 1], labels[k]
        new = np.flatnonzero(after == k - 1)
        if not len(new):
            break
        old = np.flatnonzero(before == before[new[0]])
        rest = old[after[old] != k - 1]
        a, b = sorted((int(rest[0]), int(new[0])))
        out.append((a, b, float(d[np.ix_(old, old)].max())))
    return out[::-1]


def representatives(cases: DataFrame, count: int, seed: int = 2026, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(cases with ``rep``, representatives ``(rep, x, n)``): k-means micro-clusters, or the cases themselves if there
    are no more than ``count``."""
    if count > MAX_REPRESENTATIVES:
        raise ValueError(f"at most {MAX_REPRESENTATIVES} representatives")
    if cases.limit(count + 1).count() <= count:
        own = cases.withColumn("rep", F.col("id").cast("bigint"))
        return own, own.select("rep", "x", F.lit(1).cast("bigint").alias("n"))
    fitted = materialize(kmeans.kmeans(cases, count, 1, rounds, seed))
    reps = kmeans.centroids(fitted, kmeans.dimensions(cases)).select(F.col("cluster").cast("bigint").alias("rep"), F.col("center").alias("x"), "n")
    return fitted.withColumn("rep", F.col("cluster").cast("bigint")).drop("cluster", "d2"), reps


def tree_of_representatives(reps: DataFrame, method: str, beta: float = -0.25) -> DataFrame:
    """(stage, a, b, height) merges of ``reps(rep, x, n)``, at most 2,000 rows in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        rep = pdf["rep"].to_numpy()
        n = pdf["n"].to_numpy(float)
        made = lance_williams(initial_distances(np.array(pdf["x"].tolist(), float), n, method), n, method, beta)
        return pd.DataFrame([(i + 1, rep[a], rep[b], h) for i, (a, b, h) in enumerate(made)], columns=["stage", "a", "b", "height"])

    return reps.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "stage bigint, a bigint, b bigint, height double")


def hierarchical(cases: DataFrame, method: str, ks: list[int], count: int = 1000, beta: float = -0.25, seed: int = 2026) -> DataFrame:
    """(k, id, cluster) for every k, from one hierarchy of the cases' representatives."""
    placed, reps = representatives(cases, count, seed)
    placed, reps = materialize(placed), materialize(reps)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        rep, x, n = pdf["rep"].to_numpy(), np.array(pdf["x"].tolist(), float), pdf["n"].to_numpy(float)
        d = initial_distances(x, n, method)
        split = diana(d, n, sorted({min(k, len(x)) for k in ks})) if method == "diana" else {}
        merges = [] if split else lance_williams(d, n, method, beta)
        return pd.concat([pd.DataFrame({"k": k, "rep": rep, "g": split[min(k, len(x))] if split else cut_merges(len(x), merges, k)}) for k in ks])

    cutting = reps.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "k int, rep bigint, g bigint")
    met = materialize(placed.select("id", "rep").join(cutting, "rep"))
    first = met.groupBy("k", "g").agg(F.min("id").alias("_first"))
    numbers = first.withColumn("cluster", F.row_number().over(Window.partitionBy("k").orderBy("_first"))).drop("_first")
    return met.join(F.broadcast(numbers), ["k", "g"]).select("k", "id", "cluster")
