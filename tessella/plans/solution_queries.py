"""Resampling, hierarchy tables, descriptions of a solution, choosing k; the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions.hashing import key_hash, key_uniform
from tessella.operators import describe, evaluate, kmeans, prepare, resample, schedule, select
from tessella.plans import fixtures as fx
from tessella.plans.evaluate_queries import first_centres, lloyd_sql, standardised, vector_sums, z_partition
from tessella.plans.registry import R, query
from tessella.session import materialize

C = fx.CUSTOMER
B = 6


def _h(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


T = f"t AS MATERIALIZED ({fx.hashed_sql(fx.CUSTOMERS_SQL)})"
BOOT = f"""WITH {T}, n AS (SELECT count(*) AS n FROM t), ix AS (SELECT row_number() OVER (ORDER BY id) - 1 AS "index", id FROM t),
bs AS (SELECT r.replicate, s.slot, ix.id FROM (SELECT unnest(range(1, {B + 1})) AS replicate) r, n, (SELECT unnest(range(0, (SELECT count(*) FROM t))) AS slot) s, ix
       WHERE ix."index" = {_h("'2026'", "'boot'", 'r.replicate', 's.slot')} % n.n)"""
REFIT = f"{BOOT}, rf AS (SELECT replicate, slot, id, ({_h(chr(39) + 'refit' + chr(39), 'replicate', 'id')} % 3 + 1)::INT AS cluster FROM bs)"


def _boot(spark, d):
    index = materialize(resample.indexed(fx.customers(spark, d).select("id")))
    return resample.bootstrap(index, index.count(), B)


def _refits(spark, d):
    return _boot(spark, d).withColumn("cluster", (key_hash("refit", F.col("replicate"), F.col("id")) % 3 + 1).cast("int"))


def _original(spark, d):
    return fx.hashed_partition(fx.customers(spark, d)).select("id", "cluster")


@query("r1_bootstrap", f"{BOOT} SELECT replicate, slot, id FROM bs")
def _(spark, d):
    return _boot(spark, d)


@query("r2_subsample", f"""WITH {T} SELECT replicate, id FROM (SELECT replicate, id, row_number() OVER (PARTITION BY replicate ORDER BY {_h("'2026'", "'sub'", 'replicate', 'id')}, id) AS r FROM t, (SELECT unnest(range(1, 4)) AS replicate))
WHERE r <= (SELECT least(count(*), greatest(least(6, count(*) - 1) + 1, ceil(count(*) * 0.8)))::BIGINT FROM t)""")
def _(spark, d):
    cases = fx.customers(spark, d).select("id")
    return resample.subsample(cases, resample.subsample_size(cases.count(), 6, 0.8), 3)


JACCARD = f"""{REFIT}, x AS (SELECT rf.replicate, t.cluster AS o, rf.cluster AS w, count(*)::DOUBLE AS n FROM rf JOIN t USING (id) GROUP BY 1, 2, 3),
j AS (SELECT replicate, o AS cluster, max(n / (no + nw - n)) AS jaccard FROM (SELECT *, sum(n) OVER (PARTITION BY replicate, o) AS no, sum(n) OVER (PARTITION BY replicate, w) AS nw FROM x) GROUP BY 1, 2)"""


@query("r4_cluster_jaccard", f"""{JACCARD} SELECT replicate, cluster, {R('jaccard')} AS "Jaccard" FROM j""")
def _(spark, d):
    return resample.cluster_jaccard(_original(spark, d), _refits(spark, d))


AGREE = f"""{REFIT}, v AS (SELECT replicate, id, cluster, count(*) AS v FROM rf GROUP BY 1, 2, 3), l AS (SELECT replicate, id, arg_min(cluster, (-v, cluster)) AS y FROM v GROUP BY 1, 2),
x AS (SELECT l.replicate, t.cluster AS x, l.y, count(*)::DOUBLE AS n FROM l JOIN t USING (id) GROUP BY 1, 2, 3), s AS (SELECT replicate, sum(n * (n - 1) / 2) AS sxy, sum(n) AS n FROM x GROUP BY 1),
sx AS (SELECT replicate, sum(n * (n - 1) / 2) AS sx FROM (SELECT replicate, x, sum(n) AS n FROM x GROUP BY 1, 2) GROUP BY 1), sy AS (SELECT replicate, sum(n * (n - 1) / 2) AS sy FROM (SELECT replicate, y, sum(n) AS n FROM x GROUP BY 1, 2) GROUP BY 1),
ag AS (SELECT replicate, (sxy - sx * sy / (n * (n - 1) / 2)) / ((sx + sy) / 2 - sx * sy / (n * (n - 1) / 2)) AS ari, (n * (n - 1) / 2 - sx - sy + 2 * sxy) / (n * (n - 1) / 2) AS rand FROM s JOIN sx USING (replicate) JOIN sy USING (replicate))"""


@query("r5_replicate_agreement", f"""{AGREE} SELECT replicate, {R('ari')} AS "ARI", {R('rand')} AS "Rand" FROM ag""")
def _(spark, d):
    return resample.replicate_agreement(_original(spark, d), _refits(spark, d))


@query("r7_stability", f"""{JACCARD} SELECT cluster AS "Cluster", {R('avg(jaccard)')} AS "Mean_Jaccard", {R('quantile_cont(jaccard, 0.025)')} AS "P025", {R('quantile_cont(jaccard, 0.975)')} AS "P975", {R('avg((jaccard <= 0.5)::INT)')} AS "Dissolution", {R('avg((jaccard >= 0.75)::INT)')} AS "Recovery",
count(*) AS "Valid_B", 0::BIGINT AS "Failed_B", {B}::BIGINT AS "Completed_B", {B}::BIGINT AS "Requested_B" FROM j GROUP BY cluster""")
def _(spark, d):
    original = _original(spark, d)
    return resample.stability(resample.cluster_jaccard(original, _refits(spark, d)), original, B)


@query("r7_agreement_summary", f"""{AGREE} SELECT 'ARI' AS "Index", {R('avg(ari)')} AS "Mean", {R('quantile_cont(ari, 0.025)')} AS "P025", {R('quantile_cont(ari, 0.975)')} AS "P975", count(*) AS "Valid_B", {B}::BIGINT AS "Requested_B" FROM ag
UNION ALL SELECT 'Rand', {R('avg(rand)')}, {R('quantile_cont(rand, 0.025)')}, {R('quantile_cont(rand, 0.975)')}, count(*), {B}::BIGINT FROM ag""")
def _(spark, d):
    return resample.agreement_summary(resample.replicate_agreement(_original(spark, d), _refits(spark, d)), B)


@query("r8_permuted_columns", f"""WITH {T}, ix AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS "index" FROM t), r AS (SELECT unnest(range(1, 3)) AS replicate),
{', '.join(f'''p{i} AS (SELECT replicate, row_number() OVER (PARTITION BY replicate ORDER BY {_h("'2026'", "'perm'", 'replicate', chr(39) + v + chr(39), '"index"')}, "index") - 1 AS "index", {v} FROM ix, r)''' for i, v in enumerate(C[:3]))}
SELECT replicate, "index", {', '.join(R(v, 9) + f' AS {v}' for v in C[:3])} FROM p0 JOIN p1 USING (replicate, "index") JOIN p2 USING (replicate, "index")""", digits=9)
def _(spark, d):
    return resample.permuted(resample.indexed(fx.customers(spark, d)), C[:3], 2)


@query("r9_gaussian_null")
def _(spark, d):
    return resample.gaussian(fx.customers(spark, d), C, 2)


NULLS = f"(SELECT r AS replicate, i AS \"Index\", {_h(chr(39) + 'null' + chr(39), 'r', 'i')} / 1152921504606846976.0 AS value FROM range(1, 100) x(r), (VALUES ('EESS'), ('CH'), ('DB')) y(i))"


@query("r11_empirical_p", f"""WITH z AS ({fx.hashed_sql(fx.CUSTOMERS_SQL)}), o AS (SELECT 'EESS' AS "Index", 0.9 AS v UNION ALL SELECT 'CH', 0.95 UNION ALL SELECT 'DB', 0.1), g AS (SELECT id % 100 + 1 AS replicate FROM z GROUP BY 1),
n AS (SELECT replicate, "Index", {_h("'null'", 'replicate', '"Index"')} / 1152921504606846976.0 AS value FROM g, o)
SELECT "Index", {R('any_value(v)')} AS "Observed", {R('avg(value)')} AS "Null_mean", {R('stddev_samp(value)')} AS "Null_SD", {R('(1 + count(*) FILTER (WHERE CASE "Index" WHEN $$DB$$ THEN value <= v ELSE value >= v END)) / (count(*) + 1.0)')} AS "Empirical_p",
{R('sqrt((1 + count(*) FILTER (WHERE CASE "Index" WHEN $$DB$$ THEN value <= v ELSE value >= v END)) / (count(*) + 1.0) * (1 - (1 + count(*) FILTER (WHERE CASE "Index" WHEN $$DB$$ THEN value <= v ELSE value >= v END)) / (count(*) + 1.0)) / (count(*) + 1))')} AS "MC_SE",
count(*) AS "Valid_B", 100 - count(*) AS "Failed_B", count(*) AS "Completed_B", 100::BIGINT AS "Requested_B" FROM n JOIN o USING ("Index") GROUP BY "Index" """)
def _(spark, d):
    observed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("Index"), F.lit(v).alias("value")) for i, v in (("EESS", 0.9), ("CH", 0.95), ("DB", 0.1))])).alias("r")).select("r.*")
    groups = fx.customers(spark, d).select((F.col("id") % 100 + 1).alias("replicate")).distinct()
    null = groups.crossJoin(observed.select("Index")).withColumn("value", key_uniform("null", F.col("replicate"), F.col("Index")))
    return resample.empirical_p(observed, null, 100)


_SS1 = " + ".join(f"sum({v} * {v}) - sum({v}) ** 2 / count(*)" for v in C)


@query("r12_gap_rule", f"""WITH z AS (SELECT t.*, p.label FROM ({fx.CUSTOMERS_SQL}) t, (SELECT unnest(range(1, 6)) AS label) p),
o AS (SELECT label AS k, avg(acctbal * acctbal) / label AS ss FROM z GROUP BY label), s AS (SELECT label AS k, r AS replicate, avg(acctbal * acctbal) / label * (1.1 + r / 50.0) AS ss FROM z, (SELECT unnest(range(1, 5)) AS r) GROUP BY label, r),
g AS (SELECT o.k, ln(any_value(o.ss) / 2) AS logw, avg(ln(s.ss / 2)) AS e, stddev_pop(ln(s.ss / 2)) * sqrt(1 + 1.0 / count(*)) AS se FROM o JOIN s USING (k) GROUP BY o.k),
c AS (SELECT coalesce(min(k) FILTER (WHERE ok), max(k)) AS best FROM (SELECT k, e - logw >= lead(e - logw) OVER (ORDER BY k) - lead(se) OVER (ORDER BY k) AS ok FROM g))
SELECT k AS "K", {R('logw')} AS "logW", {R('e')} AS "E_logW", {R('e - logw')} AS gap, {R('se')} AS "SE", best AS candidate FROM g, c""")
def _(spark, d):
    q = fx.customers(spark, d).agg(F.avg(F.col("acctbal") * F.col("acctbal")).alias("q"))
    observed = q.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("K"), "q").select("K", (F.col("q") / F.col("K")).alias("ss"))
    reference = observed.select("K", "ss", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("replicate")).select("K", "replicate", (F.col("ss") * (1.1 + F.col("replicate") / 50.0)).alias("ss"))
    table = materialize(resample.gap_table(observed, reference))
    return table.crossJoin(resample.gap_candidate(table).select(F.col("K").alias("candidate")))


@query("r12_gap_kmeans")
def _(spark, d):
    return resample.gap(materialize(standardised(spark, d).select("id", "x")), 3, 20)


@query("r13_halves", f"""WITH {T}, o AS (SELECT id, row_number() OVER (ORDER BY {_h("'2026'", "'half'", 'id')}) AS r, count(*) OVER () AS n FROM t) SELECT id, CASE WHEN r <= n // 2 THEN 'A' ELSE 'B' END AS half FROM o""")
def _(spark, d):
    cases = fx.customers(spark, d).select("id")
    return resample.halves(cases, cases.count())


@query("r14_split_half")
def _(spark, d):
    return resample.split_half(standardised(spark, d), 3)


def _three(spark, d):
    cases = materialize(standardised(spark, d).select("id", "x", *C))
    return cases, materialize(kmeans.kmeans(cases.select("id", "x"), 3, 20, 100))


@query("r3_bootstrap_kmeans")
def _(spark, d):
    cases, made = _three(spark, d)
    return resample.bootstrap_kmeans(cases, made.select("id", "cluster"), 3, 50)[0]


@query("r6_replicate_silhouettes", digits=8)
def _(spark, d):
    cases, made = _three(spark, d)
    return resample.bootstrap_kmeans(cases, made.select("id", "cluster"), 3, 20, pair_indices=True)[2]


@query("r10_null_simulation")
def _(spark, d):
    cases, made = _three(spark, d)
    return resample.simulate_kmeans(cases.drop("x"), C, materialize(resample.solution_indices(made, pair_indices=True)), 3, 20)


@query("c2_c3_kmeans_search")
def _(spark, d):
    return kmeans.kmeans(materialize(standardised(spark, d).select("id", "x")), 4, nstart=20, rounds=100, plus_plus=20).select("id", "cluster", "d2")


@query("c6_relocation")
def _(spark, d):
    start = z_partition(spark, d, 3).select("id", "x", "cluster")
    return kmeans.relocate(start)[0].select("id", "cluster")


#: A merge table with heights, derived from the parts: a chain of merges in order of price.
MERGES = """m AS (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) AS stage, 0::BIGINT AS a, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS b, sqrt(p_retailprice) / 31 AS height,
p_partkey AS first_a, coalesce(max(p_partkey) OVER (ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000000) AS first_b FROM part)"""
SCHEDULE = f"""WITH {MERGES}, c AS (SELECT *, sum(height * height / 2) OVER (ORDER BY stage ROWS UNBOUNDED PRECEDING) AS coef FROM m),
s AS (SELECT stage AS "Stage", least(first_a, first_b) AS "Cluster_1", greatest(first_a, first_b) AS "Cluster_2", coef AS "Coefficient", coef / nullif(lag(coef) OVER (ORDER BY stage), 0) - 1 AS "Relative_increase", (SELECT count(*) + 1 FROM m) - stage AS "Clusters_after_stage",
CASE WHEN first_a > first_b THEN b ELSE a END AS "First_stage_cluster_1", CASE WHEN first_a > first_b THEN a ELSE b END AS "First_stage_cluster_2", coalesce(lead(stage) OVER (ORDER BY stage), 0) AS "Next_stage" FROM c)"""
_SCHEDULE_ROUND = """"Stage", "Cluster_1", "Cluster_2", """ + R('"Coefficient"', 8) + """ AS "Coefficient", """ + R('"Relative_increase"', 8) + """ AS "Relative_increase", "Clusters_after_stage", "First_stage_cluster_1", "First_stage_cluster_2", "Next_stage" """


def _merges(spark, d):
    order = Window.orderBy("p_retailprice", "p_partkey")
    stage = F.row_number().over(order).cast("bigint")
    return fx.table(spark, d, "part").select(
        stage.alias("stage"), F.lit(0).cast("bigint").alias("a"), (stage - 1).alias("b"), (F.sqrt("p_retailprice") / 31).alias("height"), F.col("p_partkey").alias("first_a"),
        F.coalesce(F.max("p_partkey").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1_000_000)).alias("first_b"),
    )


def _schedule(spark, d):
    return schedule.agglomeration(materialize(_merges(spark, d)), "ward.D2")


@query("h1_h3_schedule", f"{SCHEDULE} SELECT {_SCHEDULE_ROUND} FROM s", digits=8)
def _(spark, d):
    return _schedule(spark, d)


@query("h4_largest_increase", f"""{SCHEDULE} SELECT "Clusters_after_stage" + 1 AS "K", {R('"Relative_increase"')} AS "Relative_increase", "Stage" FROM s WHERE "Clusters_after_stage" + 1 BETWEEN 2 AND 6 ORDER BY s."Relative_increase" DESC, "Stage" LIMIT 2""")
def _(spark, d):
    return schedule.largest_increase(_schedule(spark, d), [2, 3, 4, 5, 6], 2)


@query("h5_last_stages", f"""{SCHEDULE} SELECT {_SCHEDULE_ROUND} FROM s ORDER BY "Stage" DESC LIMIT 15""", digits=8)
def _(spark, d):
    return schedule.last_stages(_schedule(spark, d), 15)


@query("h6_silhouette_order", f"""WITH v AS ({fx.VECTORS_SQL}), s AS (SELECT a.id, a.cluster, b.cluster AS other, count(*) AS n, sum(list_distance(a.x, b.x)) AS d FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3),
w AS (SELECT id, cluster, coalesce((min(d / n) FILTER (WHERE other <> cluster) - max(d / n) FILTER (WHERE other = cluster)) / greatest(min(d / n) FILTER (WHERE other <> cluster), max(d / n) FILTER (WHERE other = cluster)), 0) AS width FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY cluster, width DESC, id) AS r, dense_rank() OVER (ORDER BY cluster) - 1 AS g, greatest(1, round(count(*) OVER () * 0.02))::BIGINT AS gap FROM w)
SELECT id AS "ID", cluster AS "Cluster", {R('width')} AS "Silhouette_width", r + g * gap AS "Position" FROM r""")
def _(spark, d):
    return schedule.silhouette_order(materialize(evaluate.silhouette(vector_sums(spark, d)).select("ID", "Cluster", "Silhouette_width")))


@query("h7_cut_height", f"WITH {MERGES} SELECT {R('avg(height)')} AS \"Height\" FROM (SELECT height, row_number() OVER (ORDER BY height DESC, stage DESC) AS r FROM m) WHERE r IN (3, 4)")
def _(spark, d):
    return schedule.cut_height(_merges(spark, d), 4)


@query("h7_leaf_runs", f"""WITH t AS ({fx.hashed_sql(fx.PARTS_SQL, 3)}), p AS (SELECT cluster, row_number() OVER (ORDER BY price, id) AS p FROM t), i AS (SELECT *, p - row_number() OVER (PARTITION BY cluster ORDER BY p) AS i FROM p)
SELECT cluster, min(p) AS "Start", max(p) AS "End" FROM i GROUP BY cluster, i""")
def _(spark, d):
    return schedule.leaf_runs(fx.hashed_partition(fx.parts(spark, d), 3).select("cluster", F.struct("price", "id").alias("position")))


TT = f"WITH {T}"


@query("x1_profiles", f"""{TT} SELECT coalesce(cluster::VARCHAR, 'All') AS "Cluster", count(*) AS "N", {R('100.0 * count(*) / (SELECT count(*) FROM t)')} AS "Percent", {', '.join(R(f'avg({v})', 5) + f' AS {v}' for v in C)} FROM t GROUP BY ROLLUP (cluster)""".replace(R("100.0 * count(*) / (SELECT count(*) FROM t)"), R("100.0 * count(*) / (SELECT count(*) FROM t)", 5)), digits=5)
def _(spark, d):
    return describe.profiles(fx.hashed_partition(fx.customers(spark, d)), C)


@query("x2_ordinal_profile", f"WITH t AS ({fx.hashed_sql(fx.MIXED_SQL, 3)}) SELECT cluster, {R('avg(last_priority)')} AS last_priority FROM t GROUP BY cluster")
def _(spark, d):
    t = prepare.as_ordinal(fx.hashed_partition(fx.mixed(spark, d), 3), "last_priority")
    return t.groupBy("cluster").agg(F.avg("last_priority").alias("last_priority"))


_MOM = " UNION ALL ".join(f"SELECT '{v}' AS v, cluster, count(*)::DOUBLE AS n, avg({v}) AS m, var_pop({v}) * count(*) AS w FROM t GROUP BY cluster" for v in C)
ANOVA = f"{TT}, mm AS ({_MOM}), an AS (SELECT v, sum(n) AS n, count(*) AS k, sum(w) AS w, sum(n * (m - (SELECT sum(b.n * b.m) / sum(b.n) FROM mm b WHERE b.v = mm.v)) ** 2) AS b FROM mm GROUP BY v)"


@query("x3_variance_tests", f"""{ANOVA} SELECT v AS "Variable", {R('b / (w + b)')} AS "Eta_squared", {R('(b / (k - 1)) / (w / (n - k))')} AS "F", k - 1 AS df1, (n - k)::BIGINT AS df2 FROM an""")
def _(spark, d):
    return describe.variance_tests(fx.hashed_partition(fx.customers(spark, d)), C)


@query("x3_variance_tests_p")
def _(spark, d):
    return describe.with_p(describe.variance_tests(fx.hashed_partition(fx.customers(spark, d)), C))


@query("x4_pairwise_differences", f"""{ANOVA} SELECT a.v AS "Variable", a.cluster AS "Cluster_a", b.cluster AS "Cluster_b", {R('a.m - b.m', 5)} AS "Difference", {R('abs(a.m - b.m) / sqrt(w2.ms / 2 * (1 / a.n + 1 / b.n))', 5)} AS q, w2.k, w2.df FROM mm a JOIN mm b ON a.v = b.v AND a.cluster < b.cluster
JOIN (SELECT v, k, (n - k)::BIGINT AS df, w / (n - k) AS ms FROM an) w2 ON w2.v = a.v""", digits=5)
def _(spark, d):
    return describe.pairwise_differences(fx.hashed_partition(fx.customers(spark, d)), C)


@query("x4_x5_tukey_letters")
def _(spark, d):
    return describe.letters(describe.with_tukey(describe.pairwise_differences(fx.hashed_partition(fx.customers(spark, d)), C)))


@query("x6_top_eta", f"""{ANOVA} SELECT v AS "Variable", {R('b / (w + b)')} AS "Eta_squared" FROM an ORDER BY b / (w + b) DESC LIMIT 3""")
def _(spark, d):
    return describe.top_eta(describe.variance_tests(fx.hashed_partition(fx.customers(spark, d)), C))


@query("x7_z_profiles", f"{TT} " + " UNION ALL ".join(f"SELECT cluster, '{v}' AS \"Variable\", {R(f'(avg({v}) - (SELECT avg({v}) FROM t)) / (SELECT stddev_samp({v}) FROM t)')} AS \"Z\" FROM t GROUP BY cluster" for v in C))
def _(spark, d):
    return describe.z_profiles(fx.hashed_partition(fx.customers(spark, d)), C)


@query("x8_principal_components")
def _(spark, d):
    return describe.principal_components(fx.customers(spark, d), C)[0].select("id", "PC1", "PC2")


@query("x10_heat_map")
def _(spark, d):
    return describe.heat_map(fx.hashed_partition(fx.customers(spark, d)), C)


#: A comparison table of five solutions, its values hashed from the customers' number.
_COLUMNS = ("EESS", "Silhouette", "CH", "DB", "Dunn", "WB", "C_index", "Gamma")
_N = f"(SELECT count(*) AS n FROM ({fx.CUSTOMERS_SQL}))"
COMPARISON = f"cmp AS (SELECT k AS \"K\", n AS \"N\", CASE WHEN k = 5 THEN 1 ELSE 0 END AS \"Singletons\", {', '.join(_h(chr(39) + c + chr(39), 'k', 'n') + f' % 1000 / 1000.0 AS {chr(34)}{c}{chr(34)}' for c in _COLUMNS)} FROM {_N}, range(2, 7) r(k))"
_DIRECTION = {s.column: s.better for s in select.SPEC}
_LABEL = {s.column: s.label for s in select.SPEC}
LONG = f"WITH {COMPARISON}, l AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{_LABEL[c]}' AS \"Index\", '{_DIRECTION[c] or ''}' AS \"Better\", \"K\", \"{c}\"::DOUBLE AS value, \"Singletons\" FROM cmp" for i, c in enumerate(("N", "Singletons", *_COLUMNS))) + ")"
BEST = f"""{LONG}, c AS (SELECT *, CASE WHEN "Singletons" = 0 THEN value END AS c FROM l), g AS (SELECT *, CASE "Better" WHEN 'higher' THEN max(c) OVER (PARTITION BY pos) ELSE min(c) OVER (PARTITION BY pos) END AS target, count(c) OVER (PARTITION BY pos) AS n FROM c),
b AS (SELECT pos, "Index", "Better", CASE WHEN "Better" = '' OR count(*) FILTER (WHERE c = target) >= any_value(n) THEN '' WHEN count(*) FILTER (WHERE c = target) > 3 THEN 'tie' ELSE string_agg("K"::VARCHAR, ', ' ORDER BY "K") FILTER (WHERE c = target) END AS "Best_k" FROM g GROUP BY 1, 2, 3)"""


def _comparison(spark, d):
    n = fx.customers(spark, d).agg(F.count(F.lit(1)).alias("N"))
    ks = n.withColumn("K", F.explode(F.sequence(F.lit(2), F.lit(6))))
    return materialize(ks.select("K", "N", F.when(F.col("K") == 5, 1).otherwise(0).alias("Singletons"), *[(key_hash(c, F.col("K"), F.col("N")) % 1000 / 1000.0).alias(c) for c in _COLUMNS]))


@query("y1_fit_indices", f"""{BEST}, w AS (SELECT pos, {', '.join(f'max(value) FILTER (WHERE "K" = {k}) + 0.0 AS "k = {k}"' for k in range(2, 7))} FROM l GROUP BY pos)
SELECT "Index", "Better", {', '.join(f'"k = {k}"' for k in range(2, 7))}, "Best_k" FROM b JOIN w USING (pos)""")
def _(spark, d):
    return select.fit_indices(_comparison(spark, d), [2, 3, 4, 5, 6])


@query("y2_best_k", f"""{BEST} SELECT "Index", "Better", "Best_k" FROM b""")
def _(spark, d):
    return select.best_k(select.long_indices(_comparison(spark, d))).select("Index", "Better", "Best_k")


_VOTES = f"""{BEST}, s AS (SELECT unnest(string_split("Best_k", ', '))::INT AS k, 1.0 / len(string_split("Best_k", ', ')) AS v FROM b WHERE "Better" <> '' AND "Best_k" NOT IN ('', 'tie') UNION ALL SELECT 4, 1.0), vt AS (SELECT k, sum(v)::DOUBLE AS votes, count(*) AS criteria FROM s GROUP BY k)"""


def _gap4(spark):
    return spark.range(1).select(F.lit(4).alias("K"))


@query("y3_suggested_k", f"""{_VOTES} SELECT k AS "K" FROM vt ORDER BY votes DESC, k LIMIT 1""")
def _(spark, d):
    return select.suggested_k(select.best_k(select.long_indices(_comparison(spark, d))), [2, 3, 4, 5, 6], _gap4(spark))


@query("y4_votes", f"""{_VOTES} SELECT k AS "K", {R('votes')} AS "Votes", criteria AS "Criteria" FROM vt""")
def _(spark, d):
    return select.votes(select.best_k(select.long_indices(_comparison(spark, d))), _gap4(spark))


@query("y5_findings", f"""WITH {COMPARISON} SELECT 'Separation' AS "Topic", {R('"Silhouette"')} AS "Value", CASE WHEN "Silhouette" > 0.7 THEN 'strong' WHEN "Silhouette" > 0.5 THEN 'reasonable' WHEN "Silhouette" > 0.25 THEN 'weak' ELSE 'none' END AS "Grade" FROM cmp WHERE "K" = 3
UNION ALL SELECT 'Smallest cluster', 40.0::DOUBLE, CASE WHEN 40 < greatest(5, 0.05 * "N") THEN 'small' ELSE 'sufficient' END FROM cmp WHERE "K" = 3""")
def _(spark, d):
    return select.findings(_comparison(spark, d).where("K = 3").withColumn("Minimum_N", F.lit(40)))


@query("y6_index_series", f"""{LONG} SELECT "Index", "K"::INT AS "K", value + 0.0 AS value FROM l""")
def _(spark, d):
    return select.index_series(select.long_indices(_comparison(spark, d)))


@query("e16_warnings", f"""SELECT (id % 3 + 2)::INT AS "K", CASE WHEN acctbal < 0 THEN 'negative balance' ELSE 'positive balance' END AS "Message", count(*) AS "Occurrences" FROM ({fx.CUSTOMERS_SQL}) GROUP BY 1, 2""")
def _(spark, d):
    t = fx.customers(spark, d)
    return select.warnings_log(t.select((F.col("id") % 3 + 2).cast("int").alias("K"), F.when(F.col("acctbal") < 0, "negative balance").otherwise("positive balance").alias("Message")))


@query("flagship", f"""WITH {lloyd_sql(4, 5)}, raw AS ({fx.CUSTOMERS_SQL}), j AS (SELECT raw.*, a.cluster FROM raw JOIN a USING (id))
SELECT coalesce(cluster::VARCHAR, 'All') AS "Cluster", count(*) AS "N", {R('100.0 * count(*) / (SELECT count(*) FROM j)', 5)} AS "Percent", {', '.join(R(f'avg({v})', 5) + f' AS {v}' for v in C)} FROM j GROUP BY ROLLUP (cluster)""", digits=5)
def flagship(spark, d):
    """Customers, five features each, standardised, clustered by k-means and profiled."""
    raw = materialize(fx.customers(spark, d))
    cases = materialize(prepare.assemble(prepare.scaled(raw, C, "z"), C).select("id", "x"))
    centres = kmeans.lloyd(cases, materialize(first_centres(cases, 4)), 5)
    return describe.profiles(kmeans.nearest(cases, centres).select("id", "cluster").join(raw, "id"), C)
