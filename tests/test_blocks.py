"""Jobs over pairs by blocks against brute force, in blocks of a few cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import distance as dist
from tessella.functions import matrices
from tessella.operators import blocks, centre_passes, evaluate, fuzzy, impute, kmeans, linkage, medoids


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CASES", 30)
    monkeypatch.setattr(blocks, "RIGHT_BLOCKS", 2)


def points(size=90, width=3):
    """Distinct cases, and copies of some."""
    x = np.random.default_rng(4).normal(size=(size, width))
    x[-20:-10], x[-10:] = x[:10], x[0]
    return x


def table(spark, x):
    return spark.createDataFrame([(3 * i + 1, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>")


@pytest.mark.parametrize("method", ["complete", "average", "mcquitty", "ward.D", "ward.D2", "flexible"])
def test_merges_of_blocks_are_those_of_single_steps(spark, method):
    """Rounds down to 45 groups: under flexible linkage the order of merges, too, is that of single steps."""
    x = points()
    name = "cosine" if method == "average" else "euclidean"
    want = linkage.lance_williams(matrices.square("sqeuclidean" if method == "ward.D2" else name, x), np.ones(len(x)), method)
    made = [tuple(r) for r in linkage.block_merges(table(spark, x), name, method, last=45).collect()]
    assert sorted(m[2] for m in made) == pytest.approx(sorted(h for *_, h in want), abs=1e-9)
    assert {m[:2] for m in made if m[2] > 1e-9} == {(3 * a + 1, 3 * b + 1) for a, b, h in want if h > 1e-9}


def test_spanning_tree_of_blocks(spark):
    cases = table(spark, points())
    made = linkage.block_spanning_tree(cases, "euclidean").collect()
    want = linkage.spanning_tree(dist.pairs(cases, "euclidean", blocks=2), cases.select("id")).collect()
    assert {r[:2] for r in made} == {r[:2] for r in want}
    assert sorted(r[2] for r in made) == pytest.approx(sorted(r[2] for r in want), abs=1e-9)


def test_squares_in_many_dimensions():
    """Equal cases are at zero, near ones not lost to rounding."""
    x = np.random.default_rng(1).normal(size=(50, 40)) + 100
    x[1], x[2] = x[0], x[0] + 1e-7
    d = matrices.matrix("sqeuclidean", x, x)
    assert d[0, 1] == 0 and d == pytest.approx(((x[:, None] - x[None]) ** 2).sum(2), rel=1e-9)


def test_closest_centre_takes_the_first_of_equal_ones():
    rng = np.random.default_rng(2)
    x, c = rng.integers(0, 4, (500, 3)).astype(float), rng.integers(0, 4, (60, 3)).astype(float)
    c[7] = np.inf
    near, d2 = centre_passes.closest(x, c)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (d2 == d.min(1)).all()


def test_relocation_in_passes(spark, monkeypatch):
    """At the end no move gains; the sum of squares is that of the partition; rounds that are repeated change nothing."""
    x = points(120)
    start = table(spark, x).withColumn("cluster", (F.col("id") % 4 + 1).cast("int"))
    made, trace = kmeans.relocate(start, 60)
    monkeypatch.setattr(centre_passes.Relocation, "WRITTEN", 1)
    assert sorted(made.collect()) == sorted(kmeans.relocate(start, 60)[0].collect())
    assert trace[-1]["Within_SS"] == pytest.approx(kmeans.partition_ss(made, 3).first()["ss"])
    rows = {r["id"]: r["cluster"] for r in made.collect()}
    at = np.array([rows[3 * i + 1] for i in range(len(x))])
    n = {c: (at == c).sum() for c in set(at)}
    far = {c: ((x - x[at == c].mean(0)) ** 2).sum(1) for c in n}
    for i, a in enumerate(at):
        assert all(n[b] / (n[b] + 1) * far[b][i] >= n[a] / (n[a] - 1) * far[a][i] - 1e-9 for b in n if b != a)


def test_silhouettes_do_not_copy_the_cases(spark):
    """Sums by case and cluster against all distances; the plan has no row for each case and block."""
    x = points()
    cases = table(spark, x).withColumn("cluster", (F.col("id") % 5).cast("int"))
    sums = evaluate.case_cluster_sums(cases, "euclidean")
    assert "generate" not in sums._jdf.queryExecution().optimizedPlan().toString().lower()
    d, at = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.array([(3 * i + 1) % 5 for i in range(len(x))])
    rows = {(r["id"], r["other"]): r for r in sums.collect()}
    assert len(rows) == len(x) * 5
    for (i, other), r in rows.items():
        own = (i - 1) // 3
        far = d[own, (at == other) & (np.arange(len(x)) != own)]
        assert (r["cluster"], r["n"]) == (at[own], len(far))
        assert (r["d"], r["d2"], r["low"], r["high"]) == pytest.approx((far.sum(), (far**2).sum(), far.min(), far.max()))


@pytest.mark.parametrize("name", ["jaccard", "russell_rao", "manhattan", "gower"])
def test_sums_over_later_cases(spark, name):
    x = np.random.default_rng(7).integers(0, 2, (130, 4)).astype(float)
    extra = {"ranges": [1.0] * 4} if name == "gower" else {}
    cases = table(spark, x)
    made = [evaluate.later_sums(cases, name, **extra)] + ([] if extra else [evaluate.later_sums_of_profiles(cases, name)])
    d = matrices.matrix(name, x, x, **extra)
    for sums in made:
        rows = {(r["id"] - 1) // 3: r for r in sums.collect()}
        assert sorted(rows) == list(range(len(x) - 1))
        assert all((r["n"], r["total"], r["low"], r["high"]) == (len(x) - 1 - i, pytest.approx(d[i, i + 1 :].sum()), d[i, i + 1 :].min(), d[i, i + 1 :].max()) for i, r in rows.items())


def test_medoids_and_fuzzy_of_blocks_are_those_of_pairs(spark):
    x = np.random.default_rng(9).normal(size=(70, 3)) + np.repeat([[0.0], [4.0]], 35, 0)
    cases = table(spark, x)
    pairs = dist.pairs(cases, "manhattan", blocks=2)
    made, want = medoids.block_pam(cases, "manhattan", 3), medoids.pam(pairs, cases.select("id"), 3)
    assert made[1] == want[1] and made[2] == pytest.approx(want[2]) and sorted(made[0].collect()) == sorted(want[0].select(*made[0].columns).collect())
    (a, t), (b, u) = fuzzy.block_fuzzy(cases, "manhattan", 2, rounds=6), fuzzy.fuzzy(pairs, cases.select("id"), 2, rounds=6)
    assert t == pytest.approx(u)
    assert [r["u"] for r in a.orderBy("id", "cluster").collect()] == pytest.approx([r["u"] for r in b.orderBy("id", "cluster").collect()])


def test_donors_of_blocks_by_definition(spark, monkeypatch):
    """Nearest complete cases over the variables that a case has, among equal ones the smallest id, within the threshold."""
    monkeypatch.setattr(impute, "DONOR_BLOCK", 20)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (200, 4)).astype(float)
    holes = rng.random((200, 4)) < 0.15
    rows = [(i, *[None if h else float(v) for v, h in zip(r, hole)]) for i, (r, hole) in enumerate(zip(x, holes))]
    z = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double")
    report = impute.nearest_donors(z, ["a", "b", "c", "d"], (1.0, 2.0, 1.0, 0.5), 0.4)
    assert "generate" not in report._jdf.queryExecution().optimizedPlan().toString().lower()  # no donor is copied
    w, want = np.array([1.0, 2.0, 1.0, 0.5]), {}
    full = np.flatnonzero(~holes.any(1))
    for i in np.flatnonzero(holes.any(1) & (holes.sum(1) <= 2)):
        has = ~holes[i]
        d = ((x[full][:, has] - x[i, has]) ** 2 * w[has]).sum(1) / w[has].sum()
        if d.min() <= 0.4:
            want[int(i)] = (int(full[d.argmin()]), pytest.approx(d.min()))
    assert {r["ID"]: (r["Donor_ID"], r["ASED"]) for r in report.collect()} == want
