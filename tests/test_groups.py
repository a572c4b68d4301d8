"""Methods on the representatives of each key against brute force by definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import distance as dist
from tessella.functions import matrices
from tessella.operators import groups, linkage, medoids
from tessella.session import materialize

NAMES = [*matrices.PLAIN, *matrices.WEIGHTED, "gower"]


def table(spark, x, keys=None):
    rows = [(i + 1, [None if np.isnan(v) else float(v) for v in row], *(() if keys is None else (keys[i],))) for i, row in enumerate(x)]
    return materialize(spark.createDataFrame(rows, "id bigint, x array<double>" + ("" if keys is None else ", replicate int")))


def data(name, n=24, seed=1):
    rng = np.random.default_rng(seed)
    if name in matrices.WEIGHTED:
        return (rng.random((n, 5)) < 0.5).astype(float)
    if name in ("chi_square", "phi_square"):
        return rng.integers(0, 6, (n, 5)).astype(float) + np.eye(5)[rng.integers(0, 5, n)]
    x = rng.normal(size=(n, 5)).round(3)
    if name == "gower":
        x[rng.random(x.shape) < 0.25] = np.nan
    return x


@pytest.mark.parametrize("name", NAMES)
def test_matrices_equal_expressions(spark, name):
    x = data(name)
    weights = [1.0, 2.0, 0.5, 1.0, 3.0] if name in (*matrices.WEIGHTED, "gower") else None
    ranges = [3.0, 4.0, 5.0, 3.5, 2.5] if name == "gower" else None
    made = matrices.matrix(name, x, x, weights, ranges)
    known = "euclidean" if name == "mahalanobis" else name
    for r in dist.pairs(table(spark, x), known, weights, ranges, blocks=2).collect():
        d = made[r["i"] - 1, r["j"] - 1]
        assert np.isnan(d) if r["d"] is None else d == pytest.approx(r["d"], abs=1e-9)


def merged_by_definition(d, method, beta):
    """Merges one at a time over dictionaries of groups, straight from the rule of each linkage."""
    groups_, out = {i: [i] for i in range(len(d))}, []
    far = {(i, j): d[i, j] for i in range(len(d)) for j in range(len(d)) if i != j}
    while len(groups_) > 1:
        h, a, b = min((far[a, b], a, b) for a in groups_ for b in groups_ if a < b)
        na, nb = len(groups_[a]), len(groups_[b])
        for c in groups_:
            if c not in (a, b):
                ac, bc, nc = far[a, c], far[b, c], len(groups_[c])
                new = {
                    "single": min(ac, bc), "complete": max(ac, bc), "average": (na * ac + nb * bc) / (na + nb), "mcquitty": (ac + bc) / 2,
                    "ward.D": ((na + nc) * ac + (nb + nc) * bc - nc * h) / (na + nb + nc), "ward.D2": ((na + nc) * ac + (nb + nc) * bc - nc * h) / (na + nb + nc),
                    "centroid": (na * ac + nb * bc) / (na + nb) - na * nb * h / (na + nb) ** 2, "median": (ac + bc) / 2 - h / 4,
                    "flexible": (1 - beta) / 2 * (ac + bc) + beta * h,
                }[method]
                far[a, c] = far[c, a] = new
        groups_[a] += groups_.pop(b)
        out.append((a, b, h))
    return out


@pytest.mark.parametrize("method", [m for m in linkage.TREES if m != "diana"])
@pytest.mark.parametrize("tied", [False, True])
def test_merges_by_definition(method, tied):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (30, 2)).astype(float) if tied else rng.normal(size=(30, 3))
    d = matrices.square("sqeuclidean" if method in linkage.SQUARED else "manhattan", x)
    for beta in (-0.25, 0.5) if method == "flexible" else (-0.25,):
        made = linkage.lance_williams(d, np.ones(30), method, beta)
        want = [(a, b, h**0.5 if method == "ward.D2" else h) for a, b, h in merged_by_definition(d, method, beta)]
        assert [m[:2] for m in made] == [m[:2] for m in want]
        assert [m[2] for m in made] == pytest.approx([m[2] for m in want])


def split_by_definition(d, k):
    """Divisive splits from averages that are worked out anew for every step."""
    clusters = [list(range(len(d)))]
    while len(clusters) < k:
        widest = max(range(len(clusters)), key=lambda c: (max((d[i, j] for i in clusters[c] for j in clusters[c]), default=0), -c))
        rest, splinter = clusters[widest], []
        while len(rest) > 1:
            gain = [np.mean([d[i, j] for j in rest if j != i]) - (np.mean([d[i, j] for j in splinter]) if splinter else 0.0) for i in rest]
            best = int(np.argmax(np.round(gain, 12)))
            if splinter and gain[best] <= 0:
                break
            splinter.append(rest.pop(best))
        clusters.append(splinter)
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("name", ["manhattan", "gower", "euclidean"])
@pytest.mark.parametrize("method", ["diana", "flexible"])
def test_one_step_methods_on_any_distance(spark, name, method):
    x = data(name, 40, 7)
    ranges = [3.0] * 5 if name == "gower" else None
    d = matrices.square(name, x, None, ranges)
    made = groups.grouped_fit(table(spark, x), method, [2, 3, 5], name, ranges=ranges, beta=0.5).collect()
    for k in (2, 3, 5):
        got = {}
        for r in made:
            if r["k"] == k:
                got.setdefault(r["cluster"], set()).add(r["id"] - 1)
        if method == "diana":
            want = split_by_definition(d, k)
        else:
            left = {i: {i} for i in range(40)}
            for a, b, _ in merged_by_definition(d, method, 0.5)[: 40 - k]:
                left[a] |= left.pop(b)
            want = set(map(frozenset, left.values()))
        assert set(map(frozenset, got.values())) == want
        assert [min(got[c]) for c in sorted(got)] == sorted(min(g) for g in got.values())  # numbered by first case


def test_medoids_equal_the_rounds_over_pairs(spark):
    x = data("manhattan", 45, 9)
    cases = table(spark, x)
    want, chosen, total = medoids.pam(dist.pairs(cases, "manhattan", blocks=2), cases.select("id"), 4)
    d = matrices.square("manhattan", x)
    label, mine = groups.swapped(d, np.ones(45), 4)
    assert [m + 1 for m in mine] == chosen and d[np.arange(45), np.asarray(mine)[label]].sum() == pytest.approx(total)
    made = groups.grouped_fit(cases, "pam", [4], "manhattan")
    assert {(r["id"], r["cluster"]) for r in made.collect()} == {(r["id"], r["cluster"]) for r in want.collect()}


def test_weights_stand_for_copies():
    """A point of weight three does as three equal points do."""
    x = data("euclidean", 20, 11)
    w = np.array([1, 2, 3, 1] * 5, float)
    many = np.repeat(x, w.astype(int), 0)
    place = np.repeat(np.arange(20), w.astype(int))
    for method in ("average", "complete", "ward.D2", "centroid", "pam", "fuzzy"):
        run = groups.labeller(method, [3], -0.25, "average", 300)
        few = run(x, w, matrices.square("euclidean", x))[3]
        all_ = run(many, np.ones(len(many)), matrices.square("euclidean", many))[3]
        assert len(set(zip(few[place], all_))) == len(set(all_)) == len(set(few)), method


METHODS = [*linkage.TREES, "pam", "fuzzy", "ward_relocate", "hybrid_relocate", "hybrid_kmeans", "hybrid_pam"]


@pytest.mark.parametrize("method", METHODS)
def test_keys_are_separate_runs(spark, method):
    x = np.concatenate([data("euclidean", 30, 13), data("euclidean", 22, 14)])
    x[::3] += 3
    keys = [1] * 30 + [2] * 22
    both = groups.grouped_fit(table(spark, x, keys), method, [2, 4], keys=("replicate",)).collect()
    for key in (1, 2):
        own = table(spark, x, keys).where(F.col("replicate") == key).select("id", "x")
        want = groups.grouped_fit(own, method, [2, 4]).collect()
        assert {(r["k"], r["id"], r["cluster"]) for r in both if r["replicate"] == key} == {tuple(r) for r in want} and want


@pytest.mark.parametrize(("name", "euclidean"), [("gower", False), ("manhattan", False), ("euclidean", True)])
def test_representatives_carry_all_cases(spark, name, euclidean):
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(4, 5)) * 10
    true = rng.integers(0, 4, 900)
    x = centres[true] + rng.normal(size=(900, 5))
    ranges = list((x.max(0) - x.min(0)).astype(float)) if name == "gower" else None
    cases = table(spark, x, list(map(int, rng.integers(1, 3, 900))))
    placed, reps = groups.place_cases(cases, name, 60, None, ranges, ("replicate",), euclidean=euclidean)
    assert placed.count() == 900 and reps.agg(F.sum("n")).first()[0] == 900 and reps.groupBy("replicate").count().where("count > 60").isEmpty()
    if not euclidean:  # every case is with its nearest representative
        got = reps.collect()
        for r in placed.where("id % 50 = 0").collect():
            y = np.array([q["x"] for q in sorted(got, key=lambda q: q["rep"]) if q["replicate"] == r["replicate"]])
            numbers = sorted(q["rep"] for q in got if q["replicate"] == r["replicate"])
            assert r["rep"] == numbers[int(np.argmin(matrices.matrix(name, np.array([r["x"]]), y, None, ranges)[0]))]
    for method in ("average", "pam"):
        made = groups.grouped_fit(cases, method, [4], name, 60, ranges=ranges, keys=("replicate",)).collect()
        assert len(made) == 900 and len({(r["replicate"], true[r["id"] - 1], r["cluster"]) for r in made}) == 8


def test_keys_without_a_solution_have_no_rows(spark):
    x = np.array([[0.0], [1.0], [5.0], [6.0], [2.0], [2.0]])
    made = groups.grouped_fit(table(spark, x, [1, 1, 1, 1, 2, 2]), "average", [2, 3], keys=("replicate",)).collect()
    assert {(r["replicate"], r["k"]) for r in made} == {(1, 2), (1, 3), (2, 2)}
    assert groups.grouped_fit(table(spark, x).limit(0), "average", [2]).count() == 0
