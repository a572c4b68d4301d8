"""Distances, joins, evaluation of partitions, agreement."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import distance as dist
from tessella.functions.hashing import key_uniform
from tessella.operators import agreement, evaluate, kmeans, prepare, profile, select
from tessella.plans import fixtures as fx
from tessella.plans.registry import ORACLES, R, query
from tessella.session import materialize, shared_dir
from tessella.streaming import scoring

C = fx.CUSTOMER
VEC = f"WITH v AS ({fx.VECTORS_SQL})"
FLAG_ARRAY = f"(SELECT id, [{', '.join(fx.FLAGS)}] AS x FROM ({fx.FLAGS_SQL}))"
COUNT_ARRAY = f"(SELECT id, [p1, p2, p3, p4, p5] AS x FROM ({fx.COUNTS_SQL}))"
#: Pairs are summed per case, so that an answer has a row per case and not per pair.
PER_CASE = "SELECT i AS id, count(d) AS n, " + R("sum(d)", 5) + " AS total, " + R("min(d)") + " AS low, " + R("max(d)") + " AS high FROM p GROUP BY i"


def per_case(pairs):
    return pairs.groupBy(F.col("i").alias("id")).agg(F.count("d").alias("n"), F.round(F.sum("d"), 5).alias("total"), F.min("d").alias("low"), F.max("d").alias("high"))


def arrays(df, columns):
    return df.select("id", F.array(*columns).alias("x"))


def _vector_distance(code: str, name: str, sql: str) -> None:
    @query(f"{code}_{name}", f"{VEC}, p AS (SELECT a.id AS i, b.id AS j, {sql} AS d FROM v a JOIN v b ON a.id < b.id) {PER_CASE}")
    def _(spark, d):
        return per_case(dist.pairs(fx.vectors(spark, d), name))


_vector_distance("d1", "euclidean", "list_distance(a.x, b.x)")
_vector_distance("d2", "sqeuclidean", "list_distance(a.x, b.x) ** 2")
_vector_distance("d3", "manhattan", "list_sum([abs(u[1] - u[2]) FOR u IN list_zip(a.x, b.x)])")
_vector_distance("d4", "maximum", "list_max([abs(u[1] - u[2]) FOR u IN list_zip(a.x, b.x)])")
_vector_distance("d7", "cosine", "1 - list_cosine_similarity(a.x, b.x)")


@query("d6_correlation", f"{VEC}, c AS (SELECT id, [u - list_avg(x) FOR u IN x] AS x FROM v), p AS (SELECT a.id AS i, b.id AS j, 1 - list_cosine_similarity(a.x, b.x) AS d FROM c a JOIN c b ON a.id < b.id) {PER_CASE}")
def _(spark, d):
    # Centred once per case, then the cosine of pairs is their correlation.
    rows = fx.vectors(spark, d).select("id", dist.centred(F.col("x")).alias("x"))
    return per_case(dist.pairs(materialize(rows), "cosine"))


@query("d8_spearman", f"""{VEC}, r AS (SELECT id, k, rank() OVER (PARTITION BY id ORDER BY u) + (count(*) OVER (PARTITION BY id, u) - 1) / 2.0 AS r FROM (SELECT id, unnest(x) AS u, unnest(range(1, 65)) AS k FROM v)),
c AS (SELECT id, list((r - 32.5)::DOUBLE ORDER BY k) AS x FROM r GROUP BY id), p AS (SELECT a.id AS i, b.id AS j, 1 - list_cosine_similarity(a.x, b.x) AS d FROM c a JOIN c b ON a.id < b.id) {PER_CASE}""")
def _(spark, d):
    rows = fx.vectors(spark, d).select("id", dist.centred(dist.average_ranks(F.col("x"))).alias("x"))
    return per_case(dist.pairs(materialize(rows), "cosine"))


@query("d5_mahalanobis")
def _(spark, d):
    return per_case(dist.pairs(dist.whiten(fx.customers(spark, d), C).select("id", "x"), "euclidean"))


_MIXED = ["mean_total", "n_orders", "building", "last_priority"]


@query("d9_gower", f"""WITH t AS ({fx.MIXED_SQL}), g AS (SELECT max(mean_total) - min(mean_total) AS r1, max(n_orders) - min(n_orders) AS r2, max(building) - min(building) AS r3, max(last_priority) - min(last_priority) AS r4 FROM t),
p AS (SELECT a.id AS i, b.id AS j, (abs(a.mean_total - b.mean_total) / r1 + 2 * abs(a.n_orders - b.n_orders) / r2 + abs(a.building - b.building) / r3 + abs(a.last_priority - b.last_priority) / r4) / 5 AS d
      FROM t a JOIN t b ON a.id < b.id, g) {PER_CASE}""")
def _(spark, d):
    t = fx.mixed(spark, d)
    ranges = {r["Variable"]: r["Scale"] for r in prepare.scale_model(t, _MIXED, "range").collect()}
    return per_case(dist.pairs(arrays(t, _MIXED), "gower", weights=[1, 2, 1, 1], ranges=[ranges[v] for v in _MIXED]))


@query("m4_available_gower", f"""WITH t AS ({fx.GAPS_SQL}), g AS (SELECT {', '.join(f'max({v}) - min({v}) AS r_{v}' for v in fx.GAPS)} FROM t WHERE {' OR '.join(f'{v} IS NOT NULL' for v in fx.GAPS)}),
q AS (SELECT a.id AS i, b.id AS j, ({' + '.join(f'coalesce(abs(a.{v} - b.{v}) / r_{v}, 0)' for v in fx.GAPS)}) / nullif({' + '.join(f'(a.{v} IS NOT NULL AND b.{v} IS NOT NULL)::INT' for v in fx.GAPS)}, 0) AS d
      FROM t a JOIN t b ON a.id < b.id AND ({' OR '.join(f'a.{v} IS NOT NULL' for v in fx.GAPS)}) AND ({' OR '.join(f'b.{v} IS NOT NULL' for v in fx.GAPS)}), g),
p AS (SELECT i, j, coalesce(d, greatest(1, (SELECT max(d) FROM q))) AS d FROM q)
SELECT s.*, (SELECT count(*) FROM q WHERE d IS NULL) AS no_overlap FROM ({PER_CASE}) s""")
def _(spark, d):
    t = profile.keep_cases(fx.customers_with_gaps(spark, d), fx.GAPS, available=True)
    ranges = {r["Variable"]: r["Scale"] for r in prepare.scale_model(t, fx.GAPS, "range").collect()}
    raw = materialize(dist.pairs(arrays(t, fx.GAPS), "gower", ranges=[ranges[v] for v in fx.GAPS]))
    unknown = raw.agg(F.count_if(F.col("d").isNull()).alias("no_overlap"))
    return per_case(dist.fill_unknown(raw)).crossJoin(F.broadcast(unknown))


def _flag_distance(code: str, name: str, sql: str) -> None:
    @query(f"{code}_{name}", f"WITH v AS {FLAG_ARRAY}, p AS (SELECT a.id AS i, b.id AS j, {sql} AS d FROM v a JOIN v b ON a.id < b.id) {PER_CASE}")
    def _(spark, d):
        return evaluate.later_sums_of_profiles(arrays(fx.priority_flags(spark, d), fx.FLAGS), name, [1, 2, 1, 1, 3]).withColumn("total", F.round("total", 5))


_W = "[1, 2, 1, 1, 3]"
_BOTH = f"list_sum([u[1] * u[2] * u[3] FOR u IN list_zip(a.x, b.x, {_W}::DOUBLE[])])"
_flag_distance("d10", "jaccard", f"coalesce(1 - {_BOTH} / nullif(list_sum([greatest(u[1], u[2]) * u[3] FOR u IN list_zip(a.x, b.x, {_W}::DOUBLE[])]), 0), 0)")
_flag_distance("d11", "simple_matching", f"list_sum([abs(u[1] - u[2]) * u[3] FOR u IN list_zip(a.x, b.x, {_W}::DOUBLE[])]) / 8")
_flag_distance("d12", "russell_rao", f"1 - {_BOTH} / 8")


def _count_distance(code: str, name: str, divide: str) -> None:
    chi = "(list_sum(a.x) + list_sum(b.x)) * (list_sum([u[1] ** 2 / ((u[1] + u[2]) * list_sum(a.x)) + u[2] ** 2 / ((u[1] + u[2]) * list_sum(b.x)) FOR u IN list_zip(a.x, b.x) IF u[1] + u[2] > 0]) - 1)"

    @query(f"{code}_{name}", f"WITH v AS {COUNT_ARRAY}, p AS (SELECT a.id AS i, b.id AS j, sqrt(greatest(0, {chi}) {divide}) AS d FROM v a JOIN v b ON a.id < b.id) {PER_CASE}", digits=5)
    def _(spark, d):
        return per_case(dist.pairs(arrays(fx.priority_counts(spark, d), ["p1", "p2", "p3", "p4", "p5"]), name))


_count_distance("d13", "chi_square", "")
_count_distance("d14", "phi_square", "/ (list_sum(a.x) + list_sum(b.x))")
for _code, _name in (("d13", "chi_square"), ("d14", "phi_square")):
    ORACLES[f"{_code}_{_name}"] = ORACLES[f"{_code}_{_name}"].replace("round(min(d), 6)", "round(min(d), 5)").replace("round(max(d), 6)", "round(max(d), 5)")


@query("d15_domain_checks", f"SELECT count(*) AS cases, 3 AS refused FROM ({fx.FLAGS_SQL})")
def _(spark, d):
    flags, refused = fx.priority_flags(spark, d), 0
    for df, columns, name in ((fx.customers(spark, d), C, "jaccard"), (fx.customers(spark, d), C, "chi_square"), (fx.customers_with_gaps(spark, d), C, "euclidean")):
        try:
            dist.check_domain(df, columns, name)
        except ValueError:
            refused += 1
    dist.check_domain(flags, fx.FLAGS, "jaccard")
    return flags.agg(F.count(F.lit(1)).alias("cases"), F.lit(refused).alias("refused"))


@query("d16_subset_gower", f"""WITH t AS ({fx.hashed_sql(fx.MIXED_SQL)}), g AS (SELECT max(mean_total) - min(mean_total) AS r1, max(n_orders) - min(n_orders) AS r2 FROM t),
p AS (SELECT a.id AS i, b.id AS j, (abs(a.mean_total - b.mean_total) / r1 + abs(a.n_orders - b.n_orders) / r2) / 2 AS d FROM t a JOIN t b ON a.id < b.id AND a.cluster = 1 AND b.cluster = 1, g) {PER_CASE}""")
def _(spark, d):
    t = fx.hashed_partition(fx.mixed(spark, d))
    full = {r["Variable"]: r["Scale"] for r in prepare.scale_model(t, _MIXED[:2], "range").collect()}  # of the full sample
    some = materialize(arrays(t.where("cluster = 1"), _MIXED[:2]))
    return evaluate.later_sums(some, "gower", ranges=[full[v] for v in _MIXED[:2]]).withColumn("total", F.round("total", 5))


_ZC = ", ".join(f"({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () AS {v}" for v in C)
Z_SQL = f"SELECT id, {_ZC} FROM ({fx.CUSTOMERS_SQL})"


def standardised(spark, d):
    return prepare.assemble(prepare.scaled(fx.customers(spark, d), C, "z"), C)


def z_partition(spark, d, k=4):
    return fx.hashed_partition(standardised(spark, d), k)


def first_centres(cases, k, size=5):
    first = cases.orderBy("id").limit(k).select("id", "x")
    return first.select((F.row_number().over(Window.orderBy("id"))).alias("cluster"), F.col("x").alias("center"))


def lloyd_sql(k: int, rounds: int, source: str = Z_SQL) -> str:
    """Lloyd's algorithm with the first k cases as centres and a fixed number of rounds; last CTE: a."""
    far = " + ".join(f"(z.{v} - c.{v}) ** 2" for v in C)
    ctes = [f"z AS MATERIALIZED ({source})", f"c0 AS (SELECT row_number() OVER (ORDER BY id)::INT AS cluster, {', '.join(C)} FROM (SELECT * FROM z ORDER BY id LIMIT {k}))"]
    for i in range(rounds):
        ctes.append(f"a{i} AS (SELECT z.id, arg_min(c.cluster, ({far}, c.cluster)) AS cluster FROM z, c{i} c GROUP BY z.id)")
        ctes.append(f"c{i + 1} AS (SELECT cluster, {', '.join(f'avg({v}) AS {v}' for v in C)} FROM z JOIN a{i} USING (id) GROUP BY cluster)")
    ctes.append(f"a AS (SELECT z.id, arg_min(c.cluster, ({far}, c.cluster)) AS cluster, min({far}) AS d2 FROM z, c{rounds} c GROUP BY z.id)")
    return ", ".join(ctes)


@query("j2_nearest_centre", f"WITH {lloyd_sql(4, 0)} SELECT id, cluster, {R('d2')} AS d2 FROM a")
def _(spark, d):
    cases = materialize(standardised(spark, d).select("id", "x"))
    return kmeans.nearest(cases, first_centres(cases, 4)).select("id", "cluster", "d2")


@query("j2_stream_scores", f"WITH {lloyd_sql(4, 0)} SELECT id, cluster, {R('d2')} AS d2 FROM a")
def _(spark, d):
    """The cases as a stream of files, scored by the same centres."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    cases = materialize(standardised(spark, d).select("id", "x"))
    cases.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(cases.schema).parquet(f"{base}/in")
    scoring.write_scores(scoring.classify_stream(stream, materialize(first_centres(cases, 4))), f"{base}/out", f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("c1_lloyd_rounds", f"WITH {lloyd_sql(4, 5)} SELECT id, cluster, {R('d2')} AS d2 FROM a")
def _(spark, d):
    cases = materialize(standardised(spark, d).select("id", "x"))
    centres = kmeans.lloyd(cases, materialize(first_centres(cases, 4)), 5)
    return kmeans.nearest(cases, centres).select("id", "cluster", "d2")


H = f"WITH t AS ({fx.hashed_sql(fx.CUSTOMERS_SQL)}), z AS ({fx.hashed_sql(Z_SQL)})"
_SS = " + ".join(f"sum({v} * {v}) - sum({v}) ** 2 / count(*)" for v in C)


@query("c5_within_ss", f"{H}, w AS (SELECT cluster, {_SS} AS ss FROM z GROUP BY cluster) SELECT {R('sum(ss)')} AS ss FROM w")
def _(spark, d):
    return kmeans.partition_ss(z_partition(spark, d), 5)


_CENTRES = f"SELECT cluster, count(*) AS n, {', '.join(f'avg({v}) AS {v}' for v in C)} FROM z GROUP BY cluster"


@query("c7_initial_centres", f"{H} SELECT cluster, n, {', '.join(R(v) + f' AS c{i}' for i, v in enumerate(C))} FROM ({_CENTRES})")
def _(spark, d):
    return kmeans.centroids(z_partition(spark, d), 5).select("cluster", "n", *[F.col("center")[i].alias(f"c{i}") for i in range(5)])


@query("c7_medoids", f"{VEC}, s AS (SELECT a.cluster, a.id, sum(list_distance(a.x, b.x)) AS s FROM v a JOIN v b ON a.cluster = b.cluster GROUP BY 1, 2) SELECT cluster, arg_min(id, (round(s, 9), id)) AS id FROM s GROUP BY cluster")
def _(spark, d):
    return evaluate.medoids(fx.vectors(spark, d), "euclidean")


@query("e1_sizes", f"{H}, n AS (SELECT cluster, count(*) AS n FROM t GROUP BY cluster) SELECT count(*) AS \"K\", sum(n)::BIGINT AS \"N\", min(n) AS \"Minimum_N\", count(*) FILTER (WHERE n = 1) AS \"Singletons\" FROM n")
def _(spark, d):
    return evaluate.sizes(z_partition(spark, d))


@query("e1_clusters", f"{H} SELECT cluster AS \"Cluster\", count(*) AS \"N\", {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS \"Percent\" FROM t GROUP BY cluster")
def _(spark, d):
    return evaluate.clusters(z_partition(spark, d))


@query("e2_centres_and_spread", f"{H} " + " UNION ALL ".join(f"SELECT cluster, '{v}' AS \"Variable\", {R(f'avg({v})', 5)} AS \"Mean\", {R(f'stddev_samp({v})', 5)} AS \"SD\" FROM t GROUP BY cluster" for v in C), digits=5)
def _(spark, d):
    return evaluate.centres_and_spread(fx.hashed_partition(fx.customers(spark, d)), C)


_FAR2 = " + ".join(f"(a.{v} - b.{v}) ** 2" for v in C)


@query("e3_e5_variance_indices", f"""{H}, c AS ({_CENTRES}), w AS (SELECT a.cluster, sum({_FAR2}) AS w, avg(sqrt({_FAR2})) AS s FROM z a JOIN c b ON a.cluster = b.cluster GROUP BY a.cluster),
tot AS (SELECT {_SS} AS t, count(*) AS n FROM z), k AS (SELECT sum(w) AS w, count(*) AS k FROM w),
r AS (SELECT a.cluster, max((wa.s + wb.s) / sqrt({_FAR2})) AS r FROM c a JOIN c b ON a.cluster <> b.cluster JOIN w wa ON wa.cluster = a.cluster JOIN w wb ON wb.cluster = b.cluster GROUP BY a.cluster)
SELECT {R('100 * (1 - w / t)')} AS "EESS", {R('((t - w) / (k - 1)) / (w / (n - k))')} AS "CH", (SELECT {R('avg(r)')} FROM r) AS "DB" FROM tot, k""")
def _(spark, d):
    return evaluate.variance_indices(z_partition(spark, d))


@query("e6_cluster_spread", f"""{H}, c AS ({_CENTRES}), p AS (SELECT a.cluster, avg({_FAR2}) / 5 AS m FROM z a JOIN z b ON a.cluster = b.cluster AND a.id < b.id GROUP BY a.cluster),
w AS (SELECT a.cluster, sum({_FAR2}) / count(*) / 5 AS mse FROM z a JOIN c b ON a.cluster = b.cluster GROUP BY a.cluster)
SELECT cluster, {R('mse')} AS "Centroid_MSE", {R('m')} AS "Mean_pairwise_ASED" FROM p JOIN w USING (cluster)""")
def _(spark, d):
    return evaluate.cluster_spread(z_partition(spark, d), 5.0)


_SUMS = "s AS (SELECT a.id, a.cluster, b.cluster AS other, count(*) AS n, sum(list_distance(a.x, b.x)) AS d, sum(list_distance(a.x, b.x) ** 2) AS d2, min(list_distance(a.x, b.x)) AS low, max(list_distance(a.x, b.x)) AS high FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3)"
_WIDTH = """sw AS (SELECT id AS "ID", cluster AS "Cluster", arg_min(other, (d / n, other)) FILTER (WHERE other <> cluster) AS "Neighbor",
       coalesce((min(d / n) FILTER (WHERE other <> cluster) - max(d / n) FILTER (WHERE other = cluster)) / greatest(min(d / n) FILTER (WHERE other <> cluster), max(d / n) FILTER (WHERE other = cluster)), 0) AS "Silhouette_width" FROM s GROUP BY 1, 2)"""


def vector_sums(spark, d):
    return evaluate.case_cluster_sums(fx.vectors(spark, d), "euclidean")


@query("e7_silhouette", f"""{VEC}, {_SUMS}, {_WIDTH} SELECT "ID", "Cluster", "Neighbor", {R('"Silhouette_width"')} AS "Silhouette_width" FROM sw""")
def _(spark, d):
    return evaluate.silhouette(vector_sums(spark, d))


@query("e7_silhouette_summary", f"""{VEC}, {_SUMS}, {_WIDTH} SELECT {R('avg("Silhouette_width")')} AS "Silhouette", {R('100.0 * avg(("Silhouette_width" < 0)::INT)')} AS "Negative_silhouette_pct" FROM sw""")
def _(spark, d):
    return evaluate.silhouette_summary(evaluate.silhouette(vector_sums(spark, d)))


@query("e7_squared_silhouette", f"""{H}, s AS (SELECT a.id, a.cluster, b.cluster AS other, count(*) AS n, sum({_FAR2}) AS d FROM z a JOIN z b ON a.id <> b.id GROUP BY 1, 2, 3), {_WIDTH}
SELECT "ID", "Cluster", "Neighbor", {R('"Silhouette_width"')} AS "Silhouette_width" FROM sw""")
def _(spark, d):
    return evaluate.silhouette(evaluate.squared_sums(materialize(z_partition(spark, d))))


@query("e8_e10_pair_indices", f"""{VEC}, p AS (SELECT a.cluster AS ca, b.cluster AS cb, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id < b.id), n AS (SELECT cluster, count(*) AS n FROM v GROUP BY cluster),
w AS (SELECT ca, avg(d) AS m FROM p WHERE ca = cb GROUP BY ca)
SELECT {R('min(d) FILTER (WHERE ca <> cb) / max(d) FILTER (WHERE ca = cb)')} AS "Dunn", {R('corr(d, (ca <> cb)::INT)')} AS "Point_biserial",
       {R('(SELECT sum(n * m) / sum(n) FROM w JOIN n ON n.cluster = w.ca) / avg(d) FILTER (WHERE ca <> cb)')} AS "WB" FROM p""")
def _(spark, d):
    return evaluate.pair_indices(vector_sums(spark, d).withColumn("_", F.lit(1)), ("_",)).drop("_")


_RANKS = f"""{VEC}, p AS (SELECT round(list_distance(a.x, b.x), 10) AS d, a.cluster = b.cluster AS same FROM v a JOIN v b ON a.id < b.id), m AS (SELECT count(*) FILTER (WHERE same) AS m, count(*) AS n FROM p),
o AS (SELECT d, same, row_number() OVER (ORDER BY d) AS up, row_number() OVER (ORDER BY d DESC) AS down, count(*) FILTER (WHERE NOT same) OVER (ORDER BY d RANGE UNBOUNDED PRECEDING EXCLUDE TIES) AS x FROM p),
h AS (SELECT d, count(*) FILTER (WHERE same) AS w, count(*) FILTER (WHERE NOT same) AS b FROM p GROUP BY d), c AS (SELECT d, w, b, sum(b) OVER (ORDER BY d) - b AS below, sum(b) OVER () - sum(b) OVER (ORDER BY d) AS above FROM h)
SELECT (SELECT {R('(sum(d) FILTER (WHERE same) - sum(d) FILTER (WHERE up <= m)) / (sum(d) FILTER (WHERE down <= m) - sum(d) FILTER (WHERE up <= m))')} FROM o, m) AS "C_index",
       (SELECT {R('(sum(w * above) - sum(w * below)) / (sum(w * above) + sum(w * below))')} FROM c) AS "Gamma",
       (SELECT {R('sum(w * below) / (any_value(n)::DOUBLE * (any_value(n) - 1) / 2)')} FROM c, m) AS "G_plus" """


@query("e11_e13_rank_indices", _RANKS)
def _(spark, d):
    v = fx.vectors(spark, d)
    return evaluate.rank_indices(dist.pairs(v, "euclidean"), v)


@query("e11_e13_counted_distances", _RANKS)
def _(spark, d):
    return evaluate.indices_of_histogram(evaluate.distance_counts(fx.vectors(spark, d), "euclidean"))


_POST = f"SELECT id, cluster, u / sum(u) OVER (PARTITION BY id) AS prob FROM (SELECT id, k AS cluster, 0.05 + (('0x' || substr(md5('post|' || id::VARCHAR || '|' || k::VARCHAR), 1, 15))::BIGINT / 1152921504606846976.0) AS u FROM ({fx.CUSTOMERS_SQL}), range(1, 4) r(k))"


@query("e14_mixture_criteria", f"""WITH p AS ({_POST}), c AS (SELECT id, max(prob) AS top, -sum(prob * ln(prob)) AS h FROM p GROUP BY id), s AS (SELECT count(*)::DOUBLE AS n, avg(top) AS top, sum(h) AS h FROM c)
SELECT -1234.5::DOUBLE AS "Log_likelihood", 17 AS "Parameters", 2503.0::DOUBLE AS "AIC", {R('2469 + 17 * ln(n)')} AS "BIC", {R('2469 + 17 * ln((n + 2) / 24)')} AS "SABIC", {R('2469 + 17 * (ln(n) + 1)')} AS "CAIC",
       {R('1 - h / (n * ln(3))')} AS "Relative_entropy", {R('top')} AS "Mean_max_posterior" FROM s""")
def _(spark, d):
    u = fx.customers(spark, d).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("cluster")).withColumn("u", 0.05 + key_uniform("post", F.col("id"), F.col("cluster")))
    return evaluate.mixture_criteria(u.select("id", "cluster", (F.col("u") / F.sum("u").over(Window.partitionBy("id"))).alias("prob")), -1234.5, 17)


def _solution_rows(k: int) -> str:
    return f"(WITH {lloyd_sql(k, 3)}, n AS (SELECT cluster, count(*) AS n FROM a GROUP BY cluster), tot AS (SELECT {_SS} AS t FROM z) SELECT {k} AS \"K\", sum(n)::BIGINT AS \"N\", min(n) AS \"Minimum_N\", count(*) FILTER (WHERE n = 1) AS \"Singletons\", (SELECT {R('100 * (1 - sum(w) / any_value(t))')} FROM (SELECT {' + '.join(f'sum({v} * {v}) - sum({v}) ** 2 / count(*)' for v in C)} AS w FROM z JOIN a USING (id) GROUP BY cluster), tot) AS \"EESS\", 'Completed' AS \"Status\" FROM n)"


@query("c20_e15_comparison", " UNION ALL ".join(f"SELECT * FROM {_solution_rows(k)}" for k in (2, 3, 4)))
def _(spark, d):
    cases = materialize(standardised(spark, d).select("id", "x"))
    rows = []
    for k in (2, 3, 4):
        fitted = materialize(kmeans.nearest(cases, kmeans.lloyd(cases, materialize(first_centres(cases, k)), 3)))
        rows.append(evaluate.sizes(fitted).crossJoin(evaluate.variance_indices(fitted).select("EESS")).withColumn("Status", F.lit("Completed")))
    return select.comparison(rows).select("K", "N", "Minimum_N", "Singletons", "EESS", "Status").withColumn("K", F.col("K").cast("int"))


_TWO = f"WITH a AS ({fx.hashed_sql(fx.CUSTOMERS_SQL)}), b AS (SELECT id, ntile(3) OVER (ORDER BY acctbal, id)::INT AS cluster FROM a WHERE acctbal >= 0), x AS (SELECT a.cluster AS x, b.cluster AS y, count(*) AS n FROM a JOIN b USING (id) GROUP BY 1, 2)"


def two_partitions(spark, d, k=4):
    a = materialize(fx.hashed_partition(fx.customers(spark, d), k).select("id", "cluster", "acctbal"))
    b = a.where("acctbal >= 0").select("id", F.ntile(3).over(Window.orderBy("acctbal", "id")).alias("cluster"))
    return a, b


@query("a1_contingency", f"{_TWO} SELECT * FROM x")
def _(spark, d):
    return agreement.crossed(*two_partitions(spark, d))


_C2 = "(n * (n - 1) / 2.0)"
_AGREE = f"""{_TWO}, sx AS (SELECT sum(m * (m - 1) / 2.0) AS sx, -sum(m / n * ln(m / n)) AS hx FROM (SELECT sum(n)::DOUBLE AS m, (SELECT sum(n) FROM x)::DOUBLE AS n FROM x GROUP BY x)),
sy AS (SELECT sum(m * (m - 1) / 2.0) AS sy, -sum(m / n * ln(m / n)) AS hy FROM (SELECT sum(n)::DOUBLE AS m, (SELECT sum(n) FROM x)::DOUBLE AS n FROM x GROUP BY y)),
sxy AS (SELECT sum(m * (m - 1) / 2.0) AS sxy, -sum(m / n * ln(m / n)) AS hxy, any_value(n) AS n FROM (SELECT n::DOUBLE AS m, (SELECT sum(n) FROM x)::DOUBLE AS n FROM x)),
s AS (SELECT *, n * (n - 1) / 2.0 AS p FROM sx, sy, sxy)"""


@query("a2_a4_agreement", f"""{_AGREE} SELECT n::BIGINT AS "Overlap_N", {R('100.0 * n / (SELECT count(*) FROM a)')} AS "Coverage_A", {R('100.0 * n / (SELECT count(*) FROM b)')} AS "Coverage_B", {R('(sxy - sx * sy / p) / ((sx + sy) / 2 - sx * sy / p)')} AS "ARI", {R('(p - sx - sy + 2 * sxy) / p')} AS "Rand",
{R('2 * hxy - hx - hy')} AS "VI", {R('2 * (hx + hy - hxy) / (hx + hy)')} AS "NMI" FROM s""")
def _(spark, d):
    a, b = two_partitions(spark, d)
    agreement.require_overlap(a, b)
    return agreement.compare(a, b)


@query("a5_kappa", f"""WITH a AS ({fx.hashed_sql(fx.CUSTOMERS_SQL, 3)}), b AS (SELECT id, ntile(3) OVER (ORDER BY acctbal, id)::INT AS cluster FROM a), x AS (SELECT a.cluster AS x, b.cluster AS y, count(*)::DOUBLE AS n FROM a JOIN b USING (id) GROUP BY 1, 2),
perm AS (SELECT * FROM (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) v(p, q, r)), best AS (SELECT p, q, r, sum(n) FILTER (WHERE (x = 1 AND y = p) OR (x = 2 AND y = q) OR (x = 3 AND y = r)) AS hit FROM perm, x GROUP BY ALL ORDER BY hit DESC LIMIT 1),
n AS (SELECT sum(n) AS n FROM x), rx AS (SELECT x, sum(n) AS n FROM x GROUP BY x), ry AS (SELECT CASE y WHEN p THEN 1 WHEN q THEN 2 ELSE 3 END AS x, sum(n) AS n FROM x, best GROUP BY 1)
SELECT 0 AS one, {R('(hit / n.n - pe) / (1 - pe)')} AS "Kappa", {R('100 * hit / n.n')} AS "Agreement_pct" FROM best, n, (SELECT sum(rx.n * ry.n) / (SELECT n * n FROM n) AS pe FROM rx JOIN ry USING (x))""")
def _(spark, d):
    a = fx.hashed_partition(fx.customers(spark, d), 3).select("id", "cluster", "acctbal")
    b = a.select("id", F.ntile(3).over(Window.orderBy("acctbal", "id")).alias("cluster"))
    return agreement.matched_kappa(agreement.crossed(a, b).withColumn("one", F.lit(0)), ("one",))


@query("a6_a8_centroid_match")
def _(spark, d):
    t = fx.customers(spark, d)
    return agreement.compare_centroids(fx.hashed_partition(t, 4).drop("id"), fx.hashed_partition(t, 5, "other").drop("id"), C)


@query("j1_shared_cases", f"{_TWO} SELECT count(*) AS shared, (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b FROM a JOIN b USING (id)")
def _(spark, d):
    a, b = two_partitions(spark, d)
    n = F.count(F.lit(1))
    return a.join(b, "id").agg(n.alias("shared")).crossJoin(a.agg(n.alias("in_a"))).crossJoin(b.agg(n.alias("in_b")))


@query("j3_illustrative_values", f"SELECT t.id, {R('s_acctbal')} AS supplier_balance, {R('t.acctbal')} AS acctbal FROM ({fx.CUSTOMERS_SQL}) t JOIN supplier ON s_suppkey = t.id")
def _(spark, d):
    kept = fx.customers(spark, d)
    more = prepare.as_continuous(fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("supplier_balance")), "supplier_balance")
    return kept.select("id", "acctbal").join(more, "id").select("id", "supplier_balance", "acctbal")


@query("j4_unmatched_clusters", "SELECT 'A' AS \"Side\", 3 AS \"Cluster\" UNION ALL SELECT 'A', 4 UNION ALL SELECT 'B', 1")
def _(spark, d):
    a, b = two_partitions(spark, d)
    matched = b.where("cluster <> 1").select(F.col("cluster").alias("Cluster_B"), (F.col("cluster") - 1).alias("Cluster_A")).distinct()
    return agreement.unmatched(a, b, matched)
