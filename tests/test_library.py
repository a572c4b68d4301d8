"""Helpers, guards and closed forms."""

import math
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.config import ClusterConfig
from tessella.functions import distance as dist
from tessella.functions import tails
from tessella.operators import agreement, describe, evaluate, impute, prepare, profile, resample
from tessella.session import materialize
from tessella.sources import delimited, tables
from tessella.streaming import scoring

VARIABLES = ["Stress", "Support", "Engagement"]


@pytest.mark.parametrize("bad", [dict(scaling="x"), dict(k_min=5, k_max=2), dict(fraction=0), dict(weights=(1.0,)), dict(weights=(0.0, 0.0, 0.0)), dict(method="kmeans", distance="gower"), dict(missing="available"), dict(distance="mahalanobis", method="single", weights=(1.0, 2.0, 1.0)), dict(donor_threshold=-1), dict(B=0)])
def test_config_guards(bad):
    with pytest.raises(ValueError):
        ClusterConfig(tuple(VARIABLES), "ID", **bad)


def test_assignment_is_the_best_permutation():
    rng = np.random.default_rng(3)
    for n in range(1, 6):
        for _ in range(20):
            c = rng.normal(size=(n, n))
            best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))
            assert sum(c[i, j] for i, j in agreement.assign(c)) == pytest.approx(best)
    assert len(agreement.assign(rng.normal(size=(2, 5)))) == 2 == len(agreement.assign(rng.normal(size=(5, 2))))


def test_kappa_ignores_labels():
    t = pd.DataFrame({"x": [1, 1, 2, 2], "y": [1, 2, 1, 2], "n": [2, 8, 9, 1]})
    k, pct = agreement.kappa(t)
    assert pct == pytest.approx(85) and k == pytest.approx(agreement.kappa(t.assign(y=3 - t["y"]))[0])


def test_tails():
    assert tails.f_tail(4.0, 1, 1e9) == pytest.approx(math.erfc(math.sqrt(2.0)), abs=1e-6)  # chi-square of 1 degree
    assert tails.f_tail(1.0, 5, 5) == pytest.approx(0.5)
    assert tails.tukey_tail(3.877, 3, 10) == pytest.approx(0.05, abs=1e-3)
    assert tails.tukey_tail(2.0, 2, 30) == pytest.approx(tails.f_tail(2.0, 1, 30), abs=1e-6)


def test_letters():
    assert describe.cluster_letters(3, set()) == ["a", "a", "a"]
    assert describe.cluster_letters(3, {(1, 2), (1, 3), (2, 3)}) == ["a", "b", "c"]
    assert describe.cluster_letters(3, {(1, 3)}) == ["a", "ab", "b"]


def test_agreement_of_a_partition_with_itself(example):
    part = example.select(F.col("n").alias("id"), F.col("g").alias("cluster"))
    row = agreement.compare(part, part.withColumn("cluster", 4 - F.col("cluster"))).first()
    assert row["ARI"] == pytest.approx(1) and row["Rand"] == pytest.approx(1) and row["NMI"] == pytest.approx(1) and row["VI"] == pytest.approx(0)


def test_squared_silhouette_needs_no_pairs(example):
    cases = materialize(prepare.assemble(example, VARIABLES).select(F.col("n").alias("id"), F.col("g").alias("cluster"), "x"))
    pairs = evaluate.silhouette(evaluate.case_cluster_sums(cases, "sqeuclidean", blocks=3))
    closed = evaluate.silhouette(evaluate.squared_sums(cases))
    a = {r["ID"]: r["Silhouette_width"] for r in pairs.collect()}
    b = {r["ID"]: r["Silhouette_width"] for r in closed.collect()}
    assert a == pytest.approx(b)


def test_running_totals_over_many_ranges(spark):
    df = spark.range(500).select((F.col("id") / 7).alias("value"), (F.col("id") % 5).alias("w"))
    got = {r["value"]: r["below_w"] for r in evaluate.running_totals(df, ["w"], buckets=9).collect()}
    total = 0
    for i in range(500):
        assert got[i / 7] == total
        total += i % 5


def test_mahalanobis_by_numpy(example):
    x = np.array(example.orderBy("n").select(*VARIABLES).collect(), float)
    inverse = np.linalg.inv(np.cov(x.T))
    got = dist.pairs(dist.whiten(example, VARIABLES).select(F.col("n").alias("id"), "x").where("id <= 20"), "euclidean", blocks=2)
    for r in got.collect():
        gap = x[r["i"] - 1] - x[r["j"] - 1]
        assert r["d"] == pytest.approx(math.sqrt(gap @ inverse @ gap))


def test_domain_guards(example):
    for name in ("jaccard",):
        with pytest.raises(ValueError):
            dist.check_domain(example, VARIABLES, name)
    with pytest.raises(ValueError):
        dist.check_domain(example.withColumn("Stress", F.lit(None).cast("double")), VARIABLES, "euclidean")


def test_scaling_guards(example):
    with pytest.raises(ValueError):
        prepare.scaled(example.withColumn("Stress", F.lit(1.0)), VARIABLES, "z")
    with pytest.raises(ValueError):
        profile.check_key(example, "g")


def test_binary_coding_guard(example):
    with pytest.raises(ValueError):
        prepare.as_binary(example, "g")
    assert {r[0] for r in prepare.as_binary(example.where("g < 3").withColumn("g", F.when(F.col("g") == 1, "no").otherwise("yes")), "g").select("g").distinct().collect()} == {0.0, 1.0}


def test_multiple_imputation_fills_every_cell_with_seen_values(spark, example):
    holed = materialize(example.select(F.col("n").alias("id"), *[F.when(F.col("n") % (7 + i) != 0, F.col(v)).alias(v) for i, v in enumerate(VARIABLES)]))
    made = materialize(impute.multiple_impute(holed, VARIABLES, m=2, sweeps=1))
    assert made.count() == 300 and made.where(" or ".join(f"{v} is null" for v in VARIABLES)).isEmpty()
    seen = {r[0] for r in holed.select("Stress").collect()}
    assert all(r[0] in seen for r in made.where("id % 7 = 0").select("Stress").collect())


def test_multiple_imputation_over_a_long_stretch_of_missing_values(spark):
    """Donors are the nearest observed cases, also when hundreds of missing ones stand between."""
    rows = [(i, float(i), float(2 * i + i % 3) if i < 20 or i >= 580 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    made = {(r["imputation"], r["id"]): r["b"] for r in impute.multiple_impute(df, ["a", "b"], m=2, sweeps=1).collect()}
    seen = {b for _, _, b in rows if b is not None}
    assert len(made) == 1200 and set(made.values()) <= seen
    assert all(made[m, 60] < 100 and made[m, 540] > 1000 for m in (1, 2))


def test_uniform_box_covers_the_components(example):
    cases = prepare.assemble(example, VARIABLES).select(F.col("n").alias("id"), "x")
    assert resample.uniform_box(cases, 2).count() == 300


def test_halves_are_exact(example):
    cases = example.select(F.col("n").alias("id")).where("id <= 149")
    sizes = {r["half"]: r["count"] for r in resample.halves(cases, 149).groupBy("half").count().collect()}
    assert sizes == {"A": 74, "B": 75}


def test_delimited_text(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('﻿name;amount;code\n"x; y";1.234,5;007\nb; 2,25 ;010\n\nc;NA;011\n', encoding="utf-8")
    df = delimited.read_delimited(spark, str(f))
    rows = sorted(tuple(r) for r in df.collect())
    assert df.columns == ["name", "amount", "code"]
    assert rows == [("b", 2.25, "010"), ("c", None, "011"), ("x; y", 1234.5, "007")]
    g = tmp_path / "b.dat"
    g.write_text("1 2,5\n3 4\n")
    assert sorted(tuple(r) for r in delimited.parse_numbers(delimited.read_delimited(spark, str(g), header=False)).collect())[0][0] == 1.0
    h = tmp_path / "c.csv"
    h.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(h))


@pytest.mark.parametrize(("text", "mark", "value"), [
    ("1.234,5", ",", 1234.5), ("1.234", ",", 1234.0), ("12.34", ",", None), ("0,125", ",", 0.125), (",5", ",", 0.5), ("-5,", ",", -5.0), ("1e3", ",", 1000.0), ("1,5E-2", ",", 0.015),
    ("1 234,5", ",", 1234.5), ("1'234'567.25", ".", 1234567.25), ("1,234.5", ".", 1234.5), ("1234,567", ".", None), ("+7.", ".", 7.0), (".", ".", None), ("", ".", None), ("abc", ".", None), ("1.2.3", ".", None), ("e5", ".", None),
])
def test_numbers_as_text(spark, text, mark, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(delimited.parse_number(F.col("t"), mark)).first()[0] == value


def test_votes_for_the_decimal_mark(spark):
    """What can be read in one way only, by hand."""
    votes = {"0,5": ",", "0,125": ",", "1.234,5": ",", "1.234,": ",", ",25": ",", "1234,5": ",", "1,25": ",", "0.5": ".", "0.125": ".", "1,234.5": ".", "1.5e3": ".", "1234.567": ".", "1,234": "", "12.345": "", "1.234.567": "", "1,234,567": "", "7": "", "1,2,3": "", "x": "", "0012,345": ","}
    df = spark.createDataFrame([(t,) for t in votes], "t string")
    rows = df.select("t", delimited.votes_for(F.col("t"), ",").alias("c"), delimited.votes_for(F.col("t"), ".").alias("p")).collect()
    assert {r["t"]: ("," if r["c"] else "") + ("." if r["p"] else "") for r in rows} == votes


def test_headerless_files(spark, tmp_path):
    """Comma separates two columns; it is the decimal mark only where white space separates several numbers."""
    a, b = tmp_path / "a.dat", tmp_path / "b.dat"
    a.write_text("1,2\n3,4\n")
    b.write_text("1,5 2,25\n3,0 4,5\n")
    read = lambda f: sorted(tuple(r) for r in delimited.read_delimited(spark, str(f), header=False).collect())
    assert read(a) == [(1.0, 2.0), (3.0, 4.0)] and read(b) == [(1.5, 2.25), (3.0, 4.5)]
    c = tmp_path / "c.csv"
    c.write_text("x;y\n0,125;a\n0,250;b\n")
    assert sorted(tuple(r) for r in delimited.read_delimited(spark, str(c)).collect()) == [(0.125, "a"), (0.25, "b")]


def test_results_are_written(spark, example, tmp_path):
    tables.write_results({"Data": example.select("ID", "Stress")}, ClusterConfig(tuple(VARIABLES), "ID"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/Data")).count() == 150
    assert spark.read.json(str(tmp_path / "out/settings")).first()["method"] == "ward.D2"


def test_stream_scores_equal_batch_scores(spark, example, tmp_path):
    cases = prepare.assemble(example, VARIABLES).select(F.col("n").alias("id"), "x")
    cases.repartition(3).write.parquet(str(tmp_path / "in"))
    centres = spark.createDataFrame([(1, [1.0, 4.0, 4.0]), (2, [4.0, 1.0, 2.0])], "cluster int, center array<double>")
    stream = spark.readStream.schema(cases.schema).parquet(str(tmp_path / "in"))
    scoring.write_scores(scoring.classify_stream(stream, centres), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["id"], r["cluster"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["id"], r["cluster"]) for r in scoring.nearest(cases, centres).collect()}


def test_block_sums_equal_the_expression(example):
    cases = materialize(prepare.assemble(example, VARIABLES).where("n % 3 = 0").select(F.col("n").alias("id"), F.col("g").alias("cluster"), "x"))
    for name in ("euclidean", "manhattan", "maximum"):
        blocks = evaluate.case_cluster_sums(cases, name, blocks=3)
        plain = evaluate.case_cluster_sums(cases.withColumn("k", F.lit(1)), name, blocks=2, keys=("k",))
        a = {(r["id"], r["other"]): (r["n"], r["d"], r["d2"], r["low"], r["high"]) for r in blocks.collect()}
        b = {(r["id"], r["other"]): (r["n"], r["d"], r["d2"], r["low"], r["high"]) for r in plain.collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def _numpy_logits(x, y, levels, ridge=1e-6):
    """Newton's method for one data set, from the formulas of the multinomial likelihood."""
    n, p = x.shape
    b = np.zeros((levels - 1, p))
    for _ in range(60):
        eta = np.exp(np.concatenate([np.zeros((n, 1)), x @ b.T], 1))
        prob = eta / eta.sum(1, keepdims=True)
        gradient = np.array([((y == a + 1) - prob[:, a + 1]) @ x for a in range(levels - 1)]).ravel() - ridge * n * b.ravel()
        h = np.block([[-(x * (prob[:, a + 1] * ((a == c) - prob[:, c + 1]))[:, None]).T @ x for c in range(levels - 1)] for a in range(levels - 1)]) - ridge * n * np.eye(b.size)
        b = b - np.linalg.solve(h, gradient).reshape(b.shape)
    return b


@pytest.mark.parametrize("levels", [2, 4])
def test_logits_of_each_key_by_numpy(spark, levels):
    rng = np.random.default_rng(levels)
    rows, want = [], {}
    for key in (1, 2, 3):
        x = np.column_stack([np.ones(300), rng.normal(size=(300, 2))])
        true = rng.normal(size=(levels - 1, 3))
        eta = np.exp(np.concatenate([np.zeros((300, 1)), x @ true.T], 1))
        y = np.array([rng.choice(levels, p=e / e.sum()) for e in eta])
        rows += [(key, int(a), [float(v) for v in b]) for a, b in zip(y, x)]
        want[key] = _numpy_logits(x, y, levels)
    df = materialize(spark.createDataFrame(rows, "key int, y int, x array<double>").repartition(5))
    made = impute.fit_logits(df, levels, [1, 2, 3, 4])
    for key in want:
        assert np.allclose(made.beta[key], want[key], atol=1e-7)
        own = impute.fit_logits(df.where(F.col("key") == key), levels, [key])
        assert np.allclose(own.beta[key], made.beta[key], atol=1e-9)
    assert 4 not in made.covariance and made.rounds < 20


def test_levels_that_are_told_apart_have_finite_models(spark):
    rows = [(1, int(i >= 20), [1.0, float(i)]) for i in range(40)]
    made = impute.fit_logits(spark.createDataFrame(rows, "key int, y int, x array<double>"), 2, [1])
    assert np.isfinite(made.beta[1]).all() and made.beta[1][0, 1] > 0


def test_text_is_imputed_by_its_models(spark):
    """Gaps in text that depends on a number: the levels imputed follow the number as the hidden ones do."""
    rng = np.random.default_rng(8)
    rows, hidden = [], {}
    for i in range(1500):
        a = float(rng.normal())
        side = "yes" if rng.random() < 1 / (1 + np.exp(-2 * a)) else "no"
        kind = rng.choice(["p", "q", "r"], p=(w := np.exp([0.0, a, -a])) / w.sum())
        hidden[i] = (side, str(kind))
        rows.append((i, a if i % 11 else None, None if rng.random() < 0.3 and a > 0 else side, None if rng.random() < 0.3 else str(kind), None))
    df = materialize(spark.createDataFrame(rows, "id bigint, a double, side string, kind string, empty string"))
    made = materialize(impute.multiple_impute(df, ["a", "side", "kind", "empty"], m=4, sweeps=3))
    assert made.count() == 6000 and made.where("a is null or side is null or kind is null or empty is not null").isEmpty()
    of = {i: r for i, *r in rows}
    for at, name in ((1, "side"), (2, "kind")):
        gaps = [i for i in of if of[i][at] is None]
        got = [(r["id"], r[name]) for r in made.where(F.col("id").isin(gaps)).collect()]
        for level in {h[at - 1] for h in hidden.values()}:
            share = np.mean([v == level for _, v in got])
            assert abs(share - np.mean([hidden[i][at - 1] == level for i in gaps])) < 0.08, (name, level)
        high = [v for i, v in got if of[i][0] is not None and of[i][0] > 0.8]
        assert high.count("yes" if name == "side" else "q") > 0.6 * len(high)
    kept = made.join(df.select("id", F.col("side").alias("was")), "id").where("was is not null and was <> side")
    assert kept.isEmpty()
    again = impute.multiple_impute(df.repartition(6), ["a", "side", "kind", "empty"], m=4, sweeps=3)
    assert again.exceptAll(made).isEmpty()


def test_too_many_levels_are_refused(spark):
    df = spark.range(80).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("t"))
    with pytest.raises(ValueError, match="more than 50"):
        impute.multiple_impute(df, ["t"], m=2)


def test_consensus_of_classes_expands_to_that_of_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(m, i, int(rng.integers(0, 3))) for m in range(1, 5) for i in range(40) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "imputation int, id bigint, cluster int")
    of = {}
    for m, i, c in rows:
        of.setdefault(i, {})[m] = c
    want = {}
    for i in of:
        for j in of:
            both = of[i].keys() & of[j].keys()
            same = sum(of[i][m] == of[j][m] for m in both)
            if i < j and same:
                want[i, j] = (pytest.approx(same / len(both)), len(both))
    got = {(r["i"], r["j"]): (r["Consensus"], r["Imputations"]) for r in impute.consensus(df).collect()}
    assert got == want
    classes, members, pairs = impute.consensus_classes(df)
    assert classes.agg(F.sum("Cases")).first()[0] == len(of) == members.count()
    assert classes.count() == len({tuple(sorted(v.items())) for v in of.values()})
    assert pairs.where("a = b").count() == classes.count() and pairs.where("a = b and Consensus <> 1").isEmpty()


def test_text_is_read_by_its_bytes(spark, tmp_path):
    """Windows-1252, a byte-order mark, and a quoted line break; alone and as files of one folder."""
    rows = {"w": "name;x\nM\u00fcller \u20ac;1,5\nb;2,5\n".encode("cp1252"), "bom": b"\xef\xbb\xbf" + "name;x\nJos\u00e9;3,5\n".encode(), "quote": 'name;x\n"two\nlines; one field";4,5\n"say ""so""";5,5\n'.encode()}
    want = {"w": [("M\u00fcller \u20ac", 1.5), ("b", 2.5)], "bom": [("Jos\u00e9", 3.5)], "quote": [('say "so"', 5.5), ("two\nlines; one field", 4.5)]}
    folder = tmp_path / "all"
    folder.mkdir()
    for name, data in rows.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
        (folder / f"{name}.csv").write_bytes(data)
        df = delimited.read_delimited(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["name", "x"] and sorted(tuple(r) for r in df.collect()) == want[name], name
    every = delimited.read_delimited(spark, str(folder))
    assert sorted(tuple(r) for r in every.collect()) == sorted(r for rows in want.values() for r in rows)
    spaced = tmp_path / "s.dat"
    spaced.write_bytes("1.5 \u00e9\n2.5 b\n".encode("cp1252"))
    assert sorted(tuple(r) for r in delimited.read_delimited(spark, str(spaced), header=False).collect()) == [(1.5, "\u00e9"), (2.5, "b")]


@pytest.mark.parametrize("name", ["manhattan", "gower"])
def test_landmark_scaling_of_all_cases_is_the_classical_one(spark, name):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 4)) * [5, 2, 1, 1]
    ranges = [float(v) for v in x.max(0) - x.min(0)] if name == "gower" else None
    df = materialize(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>"))
    d = np.array([[np.sum(np.abs(a - b) / (ranges or 1)) / (4 if ranges else 1) for b in x] for a in x])
    j = np.eye(60) - 1 / 60
    values, vectors = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    want = vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2])
    made = sorted(describe.landmark_scaling(df, name, None, ranges).collect())
    for c in (1, 2):
        got = np.array([r[c] for r in made])
        assert np.allclose(got * np.sign(got @ want[:, c - 1]), want[:, c - 1], atol=1e-8)
    few = np.array([tuple(r)[1:] for r in sorted(describe.landmark_scaling(df, name, None, ranges, count=25).collect())])
    assert abs(np.corrcoef(few[:, 0], want[:, 0])[0, 1]) > 0.95 and len(few) == 60


def test_components_and_heat_map_by_numpy(spark, example):
    cases = example.select(F.col("n").alias("id"), F.col("g").alias("cluster"), *VARIABLES)
    rows = sorted(cases.collect())
    x = np.array([tuple(r)[2:] for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, values, v = np.linalg.svd(z, full_matrices=False)
    scored, explained = describe.principal_components(cases, VARIABLES)
    assert explained == pytest.approx([100 * s * s / 149 / 3 for s in values[:2]])
    got = np.array([[r["PC1"], r["PC2"]] for r in sorted(scored.collect())])
    want = z @ v[:2].T
    assert np.allclose(np.abs((got * want).sum(0)), (want * want).sum(0)) and np.allclose(np.abs(got), np.abs(want))
    heat = describe.heat_map(cases, VARIABLES).collect()
    by = {r["id"]: r for r in heat}
    for i, r in enumerate(rows):
        assert [by[r["id"]][c] for c in VARIABLES] == pytest.approx(list(np.clip(z[i], -2.5, 2.5)))
    for g in (1, 2, 3):
        order = sorted((r for r in heat if r["cluster"] == g), key=lambda r: r["Position"])
        at = [got[r["id"] - 1, 0] for r in order]
        assert [r["Position"] for r in order] == list(range(1, 51)) and at == sorted(at)


def test_gaussian_null_has_the_moments_of_the_cases(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.3]]) + [5, -1, 0]
    df = materialize(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double, c double"))
    made = np.array([tuple(r) for r in resample.gaussian(df, ["a", "b", "c"], 2).where("replicate = 2").select("a", "b", "c").collect()])
    assert len(made) == 4000 and np.allclose(made.mean(0), x.mean(0), atol=0.15) and np.allclose(np.cov(made.T), np.cov(x.T), atol=0.35)


def test_compare_centroids_by_hand(spark, example):
    a = example.select(F.col("g").alias("cluster"), *VARIABLES)
    b = example.withColumn("cluster", F.when(F.col("g") == 1, 7).when(F.col("g") == 2, 5).otherwise(F.when(F.col("n") % 2 == 0, 6).otherwise(8))).select("cluster", *VARIABLES)
    made = agreement.compare_centroids(a, b, VARIABLES)
    table = made.toPandas() if hasattr(made, "toPandas") else made
    text = table.to_string()
    assert len(table) == 4 and table["ASED"].notna().sum() == 3, text
    x, y = a.toPandas(), b.toPandas()
    m, s = x[VARIABLES].mean(), x[VARIABLES].std(ddof=1)
    gap = ((((x[x.cluster == 1][VARIABLES] - m) / s).mean() - ((y[y.cluster == 7][VARIABLES] - m) / s).mean()) ** 2).mean()
    assert gap == pytest.approx(0.0, abs=1e-12) and table["ASED"].min() == pytest.approx(0.0, abs=1e-9)


def test_findings_and_close_second(spark):
    from tessella.operators import select

    row = spark.createDataFrame([(3, 100, 4, 0.55, 0.8, 0.04, 0.7, 0.9)], "K int, N int, Minimum_N int, Silhouette double, Bootstrap_min_Jaccard double, Simulation_p_Silhouette double, Invariance double, Relative_entropy double")
    assert {r["Topic"]: r["Grade"] for r in select.findings(row).collect()} == {"Smallest cluster": "small", "Separation": "reasonable", "Stability": "stable", "Structure beyond chance": "supported", "Replication": "replicated", "Classification certainty": "high"}
    votes = spark.createDataFrame([(2, 1.0, 3), (3, 2.0, 4), (4, 0.5, 1)], "K int, Votes double, Criteria int")
    assert [tuple(r) for r in select.close_second(votes, 3).collect()] == [(2, 3)] and select.close_second(votes.where("K <> 2"), 3).count() == 0
