"""Sources, profiling, coding, scaling and missing data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.config import ClusterConfig
from tessella.functions.hashing import key_hash, key_uniform
from tessella.operators import impute, prepare, profile
from tessella.plans import fixtures as fx
from tessella.plans.registry import R, query
from tessella.session import shared_dir
from tessella.sources import delimited, tables

C, G = fx.CUSTOMER, fx.GAPS
GAPS = f"WITH t AS ({fx.GAPS_SQL})"
CUSTOMERS = f"WITH t AS ({fx.CUSTOMERS_SQL})"
MISSING = " + ".join(f"({v} IS NULL)::INT" for v in C)


def each(template: str, variables=C) -> str:
    return " UNION ALL ".join(template.format(v=v) for v in variables)


@query("s1_read_cases", "SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice AS price FROM part")
def _(spark, d):
    return tables.read_cases(spark, f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


PARTS_TEXT = "SELECT id, round(size, 6) + 0.0 AS size, round(price, 6) + 0.0 AS price, name FROM (SELECT p_partkey::DOUBLE AS id, p_size::DOUBLE AS size, p_retailprice AS price, p_name AS name FROM part)"


@query("s2_s3_delimited_text", PARTS_TEXT)
def _(spark, d):
    """The parts written as text with semicolons and decimal commas, then read with everything inferred."""
    price = F.translate(F.format_number("p_retailprice", 2), ".,", ",.")
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    rows = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias(" size"), price.alias("price"), F.col("p_name").alias("name"))
    rows.write.option("sep", ";").option("header", True).csv(path)
    return delimited.read_delimited(spark, path)


@query("s8_written_results", "SELECT p_partkey AS id, round(p_retailprice, 6) + 0.0 AS price FROM part")
def _(spark, d):
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    tables.write_results({"Prices": fx.parts(spark, d).select("id", "price")}, ClusterConfig(("price",), "id"), path)
    return spark.read.option("header", True).schema("id bigint, price double").csv(f"{path}/Prices")


#: Every order's total as 112.946,26 (comma), as a millionth part 0,113 (comma: no whole number starts with 0), rounded
#: down as 112,946 (either: no vote), and for odd keys as 1.12946E5 (point).
@query("s4_decimal_votes", """SELECT count(*) + count(*) FILTER (WHERE round(o_totalprice / 1e6, 3) < 1) AS "Comma", count(*) FILTER (WHERE o_orderkey % 2 = 1) AS "Dot" FROM orders""")
def _(spark, d):
    orders = fx.table(spark, d, "orders")
    swapped = lambda c, digits: F.translate(F.format_number(c, digits), ".,", ",.")
    forms = orders.select(swapped(F.col("o_totalprice"), 2).alias("a"), swapped(F.col("o_totalprice") / 1e6, 3).alias("b"), F.format_number(F.floor("o_totalprice"), 0).alias("c"), F.when(F.col("o_orderkey") % 2 == 1, F.format_string("%.5E", F.col("o_totalprice").cast("double"))).alias("e"))
    return delimited.decimal_votes(forms, ["a", "b", "c", "e"])


@query("s5_parse_numbers", "SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS s, lpad(o_custkey::VARCHAR, 8, '0') AS code FROM orders")
def _(spark, d):
    return delimited.parse_numbers(fx.number_text(spark, d))


@query("s6_clean", "SELECT o_orderkey AS \"key\", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS \"V2\" FROM orders")
def _(spark, d):
    raw = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias(" key "), F.col("o_orderdate").alias("  "), F.lit(None).cast("string").alias("empty"))
    blank = spark.range(1).select(F.lit(None).cast("bigint").alias(" key "), F.lit(None).cast("timestamp").alias("  "), F.lit(None).cast("string").alias("empty"))
    return tables.clean(raw.unionByName(blank))


@query("s7_with_clusters", f"""
WITH t AS ({fx.hashed_sql(fx.PARTS_SQL)})
SELECT id, {R('size')} AS size, {R('price')} AS price, CASE WHEN size > 3 THEN cluster % 2 END AS "Cluster_k2", CASE WHEN size > 3 THEN cluster % 3 END AS "Cluster_k3" FROM t""")
def _(spark, d):
    cases = fx.parts(spark, d)
    fixed = fx.hashed_partition(cases).where("size > 3")
    member = fixed.select("id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k"), "cluster").withColumn("cluster", F.col("cluster") % F.col("k"))
    return tables.with_clusters(cases, "id", member, [2, 3])


@query("p1_describe", f"""{GAPS}, m AS (SELECT *, {MISSING} AS missing FROM t)
{each("SELECT '{v}' AS \"Variable\", count({v}) AS \"N\", count(*) - count({v}) AS \"Missing\", " + R('avg({v})', 5) + " AS \"Mean\", " + R('stddev_samp({v})', 5) + " AS \"SD\", " + R('min({v})', 5) + " AS \"Minimum\", " + R('max({v})', 5) + " AS \"Maximum\", count(*) FILTER (WHERE missing = 1 AND {v} IS NULL) AS \"Cases_recovered\" FROM m")}""", digits=5)
def _(spark, d):
    return profile.describe(fx.customers_with_gaps(spark, d), C)


@query("p2_cases_recovered", f"""{GAPS}, m AS (SELECT *, {MISSING} AS missing FROM t)
{each("SELECT '{v}' AS \"Variable\", count(*) FILTER (WHERE missing - ({v} IS NULL)::INT = 0) - count(*) FILTER (WHERE missing = 0) AS \"Cases_recovered\" FROM m")}""")
def _(spark, d):
    return profile.describe(fx.customers_with_gaps(spark, d), C).select("Variable", "Cases_recovered")


@query("p3_missingness", f"""{GAPS} {each("SELECT '{v}' AS \"Variable\", count(*) AS \"N\", count(*) - count({v}) AS \"Missing\", " + R('100.0 * (count(*) - count({v})) / count(*)') + " AS \"Missing_percent\" FROM t")}""")
def _(spark, d):
    return profile.missingness(fx.customers_with_gaps(spark, d), C)


@query("p4_missing_patterns", f"""{GAPS}
SELECT coalesce(nullif(concat_ws(' | ', {', '.join(f"CASE WHEN {v} IS NULL THEN '{v}' END" for v in C)}), ''), 'Complete') AS "Missing_variables",
       count(*) AS "N", {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS "Percent" FROM t GROUP BY 1""")
def _(spark, d):
    return profile.missing_patterns(fx.customers_with_gaps(spark, d), C)


_LEVEL_VARIABLES = ["p_size", "p_retailprice", "p_brand", "p_type"]


@query("p5_default_levels", """
SELECT 'mean_total' AS "Variable", CASE WHEN count(DISTINCT mean_total) = 2 THEN 'binary' WHEN count(DISTINCT mean_total) BETWEEN 3 AND 7 AND bool_and(abs(mean_total - round(mean_total)) < 1e-9) THEN 'ordinal' ELSE 'continuous' END AS "Level" FROM t
UNION ALL SELECT 'building', CASE WHEN count(DISTINCT building) = 2 THEN 'binary' ELSE 'continuous' END FROM t
UNION ALL SELECT 'last_priority', CASE WHEN count(DISTINCT last_priority) = 2 THEN 'binary' WHEN count(DISTINCT last_priority) BETWEEN 3 AND 7 AND bool_and(abs(last_priority - round(last_priority)) < 1e-9) THEN 'ordinal' ELSE 'continuous' END FROM t
""".replace("FROM t", f"FROM ({fx.MIXED_SQL})"))
def _(spark, d):
    return profile.default_levels(fx.mixed(spark, d), ["mean_total", "building", "last_priority"])


@query("p6_auto_levels", """
SELECT 'p_size' AS "Variable", 'continuous' AS "Level" UNION ALL SELECT 'p_retailprice', 'continuous'
UNION ALL SELECT 'p_brand', CASE WHEN count(DISTINCT p_brand) <= 2 THEN 'binary' WHEN count(TRY_CAST(p_brand AS DOUBLE)) = count(p_brand) THEN 'continuous' ELSE 'text' END FROM part
UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT p_type) <= 2 THEN 'binary' WHEN count(TRY_CAST(p_type AS DOUBLE)) = count(p_type) THEN 'continuous' ELSE 'text' END FROM part""")
def _(spark, d):
    return profile.auto_levels(fx.table(spark, d, "part"), _LEVEL_VARIABLES)


@query("p7_level_summary", f"""WITH t AS ({fx.MIXED_SQL})
SELECT 'last_priority' AS "Variable", CASE WHEN count(DISTINCT last_priority) > 7 THEN 'range' ELSE string_agg(DISTINCT last_priority::VARCHAR, ', ' ORDER BY last_priority::VARCHAR) END AS "Summary" FROM t
UNION ALL SELECT 'building', string_agg(DISTINCT building::VARCHAR, ', ' ORDER BY building::VARCHAR) FROM t
UNION ALL SELECT 'n_orders', min(n_orders)::VARCHAR || ' to ' || max(n_orders)::VARCHAR FROM t
UNION ALL SELECT 'p_type', (SELECT count(DISTINCT p_type)::VARCHAR || ' categories' FROM part)""")
def _(spark, d):
    return profile.summarise_levels(fx.mixed(spark, d), ["last_priority", "building", "n_orders"]).unionByName(profile.summarise_levels(fx.table(spark, d, "part"), ["p_type"]))


@query("p8_id_columns", """
SELECT 'p_partkey' AS "Variable", count(DISTINCT p_partkey) = count(*) AND count(p_partkey) = count(*) AS "Unique", true AS "Named" FROM part
UNION ALL SELECT 'p_name', count(DISTINCT p_name) = count(*) AND count(p_name) = count(*), false FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) = count(*), false FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) = count(*), false FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size) = count(*), false FROM part
UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice) = count(*), false FROM part""")
def _(spark, d):
    return profile.id_columns(fx.table(spark, d, "part"))


@query("p9_key_problems", """
SELECT count(*) FILTER (WHERE l_returnflag IS NULL) AS "Nulls", count(*) FILTER (WHERE trim(l_returnflag) = '') AS "Empty",
       (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag HAVING count(*) > 1)) AS "Duplicated" FROM lineitem""")
def _(spark, d):
    return profile.key_problems(fx.table(spark, d, "lineitem"), "l_returnflag")


@query("p10_unusable_variables", """
SELECT 'p_type' AS "Variable", 'text with more than two categories' AS "Reason" UNION ALL SELECT 'flat', 'constant' UNION ALL SELECT 'nothing', 'no value'""")
def _(spark, d):
    t = fx.table(spark, d, "part").withColumns({"flat": F.lit(1.0), "nothing": F.lit(None).cast("double")})
    return profile.unusable_variables(t, ["p_size", "p_type", "flat", "nothing"])


@query("p11_usable_cases", f"""{GAPS} SELECT count(*) AS "Cases", count(*) FILTER (WHERE {MISSING} = 0) AS "Complete", count(*) FILTER (WHERE {MISSING} < 5) AS "Any_value" FROM t""")
def _(spark, d):
    return profile.usable_cases(fx.customers_with_gaps(spark, d), C)


_ALL = ", ".join(f"{R(v, 9)} AS {v}" for v in C)


@query("p12_complete_cases", f"{GAPS} SELECT id, {_ALL} FROM t WHERE {MISSING} = 0", digits=9)
def _(spark, d):
    return profile.keep_cases(fx.customers_with_gaps(spark, d), C)


@query("p13_case_audit", f"""{GAPS} SELECT id AS "ID", {MISSING} AS "Original_missing", CASE WHEN {MISSING} <= 2 THEN {MISSING} ELSE 0 END AS "Imputed_cells",
       CASE WHEN {MISSING} <= 2 THEN 'Retained' ELSE 'Excluded missing data' END AS "Status" FROM t""")
def _(spark, d):
    t = fx.customers_with_gaps(spark, d)
    return profile.case_audit(t, impute.mean_impute(t, C, 0.5), "id", C)


@query("p14_preview", f"{CUSTOMERS} SELECT id, {_ALL} FROM t ORDER BY id LIMIT 15", digits=9)
def _(spark, d):
    return profile.preview(fx.customers(spark, d), "id")


@query("p15_distinct_profiles", "SELECT count(*) AS profiles FROM (SELECT DISTINCT p_size, p_retailprice FROM part)")
def _(spark, d):
    cases = fx.parts(spark, d)
    profile.check_profiles(cases, ["size", "price"], 6)
    return cases.select("size", "price").distinct().agg(F.count(F.lit(1)).alias("profiles"))


@query("t1_binary_coding", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = (SELECT max(o_orderstatus) FROM orders WHERE o_orderstatus IN ('F', 'O')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(spark, d):
    t = fx.table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return prepare.as_binary(t, "status")


@query("t2_ordinal_coding", """
SELECT o_orderkey AS id, left(o_orderpriority, 1)::DOUBLE AS priority, dense_rank() OVER (ORDER BY o_custkey % 5)::DOUBLE AS code FROM orders""")
def _(spark, d):
    t = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 5).alias("code"))
    return prepare.as_ordinal(prepare.as_ordinal(t, "priority", order=fx.PRIORITIES), "code", rank=True).select("id", "priority", "code")


@query("t3_continuous_coding", "SELECT o_orderkey AS id, o_totalprice AS price, (o_orderkey % 2 = 0)::INT::DOUBLE AS even FROM orders", digits=4)
def _(spark, d):
    t = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("price"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    return prepare.as_continuous(prepare.as_continuous(t, "price"), "even")


def _scaled(kind: str, expression: str) -> None:
    sql = f"{CUSTOMERS} SELECT id, {', '.join(R(expression.format(v=v), 9) + f' AS {v}' for v in C)} FROM t"

    @query(f"t_scale_{kind}", sql, digits=9)
    def _(spark, d):
        return prepare.scaled(fx.customers(spark, d), C, kind)


_scaled("z", "({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER ()")
_scaled("range", "({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ())")
_scaled("none", "{v}")


@query("t6_scale_robust", f"""{CUSTOMERS}, m AS (SELECT {', '.join(f'median({v}) AS m_{v}' for v in C)} FROM t),
s AS (SELECT {', '.join(f'1.4826 * median(abs({v} - m_{v})) AS s_{v}' for v in C)} FROM t, m)
SELECT id, {', '.join(R(f'({v} - m_{v}) / s_{v}') + f' AS {v}' for v in C)} FROM t, m, s""")
def _(spark, d):
    return prepare.scaled(fx.customers(spark, d), C, "robust")


@query("t8_weighted_cases", f"""{CUSTOMERS} SELECT id, {', '.join(R(f'({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () * sqrt({i + 1}.0)') + f' AS x{i}' for i, v in enumerate(C))} FROM t""")
def _(spark, d):
    z = prepare.assemble(prepare.scaled(fx.customers(spark, d), C, "z"), C, (1.0, 2.0, 3.0, 4.0, 5.0))
    return z.select("id", *[F.col("x")[i].alias(f"x{i}") for i in range(5)])


@query("t9_prepared_cases", f"""{CUSTOMERS} SELECT id, {', '.join(R(f'({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER ()') + f' AS x{i}' for i, v in enumerate(C))} FROM t""")
def _(spark, d):
    made = prepare.prepare(fx.customers(spark, d), ClusterConfig(tuple(C), "id"))
    return made.cases.select("id", *[F.col("x")[i].alias(f"x{i}") for i in range(5)])


@query("m1_mean_imputation", f"""{GAPS}, m AS (SELECT {', '.join(f'avg({v}) AS m_{v}' for v in C)} FROM t)
SELECT id, {', '.join(R(f'CASE WHEN {MISSING} <= 2 THEN coalesce({v}, m_{v}) ELSE {v} END', 9) + f' AS {v}' for v in C)} FROM t, m""", digits=9)
def _(spark, d):
    return impute.mean_impute(fx.customers_with_gaps(spark, d), C, 0.5)


_Z = ", ".join(f"({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () AS {v}" for v in C)
_DONORS = f"""{GAPS}, z AS (SELECT id, {_Z}, {MISSING} AS missing FROM t),
p AS (SELECT r.id AS rid, d.id AS did, ({' + '.join(f'coalesce((r.{v} - d.{v}) ** 2, 0)' for v in C)}) / ({' + '.join(f'(r.{v} IS NOT NULL)::INT' for v in C)}) AS ased
      FROM z r JOIN z d ON r.missing BETWEEN 1 AND 2 AND d.missing = 0),
b AS (SELECT rid, arg_min(did, (ased, did)) AS did, min(ased) AS ased FROM p GROUP BY rid HAVING min(ased) <= 1)"""


def _filled(spark, d):
    t = fx.customers_with_gaps(spark, d)
    return impute.neighbour_impute(t, prepare.scaled(t, C, "z"), C, (1.0,) * 5, 1.0, 0.5)


@query("m2_neighbour_imputation", f"""{_DONORS} SELECT t.id, {', '.join(R(f'coalesce(t.{v}, x.{v})', 9) + f' AS {v}' for v in C)} FROM t LEFT JOIN b ON b.rid = t.id LEFT JOIN t x ON x.id = b.did""", digits=9)
def _(spark, d):
    return _filled(spark, d)[0]


@query("m3_donor_report", f"""{_DONORS} SELECT rid AS "ID", did AS "Donor_ID", {R('ased')} AS "ASED" FROM b""")
def _(spark, d):
    return _filled(spark, d)[1]


_MEMBERS = f"SELECT i AS imputation, id, ((('0x' || substr(md5('mi|' || i::VARCHAR || '|' || id::VARCHAR), 1, 15))::BIGINT % 40) + 1)::INT AS cluster FROM ({fx.CUSTOMERS_SQL}), range(1, 4) r(i) WHERE acctbal >= 0 OR i <> 2"


def _members(spark, d):
    every = fx.customers(spark, d).select("id", "acctbal", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("imputation")).where("acctbal >= 0 or imputation <> 2").drop("acctbal")
    return every.withColumn("cluster", (key_hash("mi", F.col("imputation"), F.col("id")) % 40 + 1).cast("int"))


# One row per case, a column per imputation: a pair's counts are then plain arithmetic.
_WIDE = f"w AS MATERIALIZED (SELECT id, {', '.join(f'max(cluster) FILTER (WHERE imputation = {i}) AS c{i}' for i in (1, 2, 3))} FROM ({_MEMBERS}) GROUP BY id)"
_TOGETHER = " + ".join(f"coalesce(a.c{i} = b.c{i}, false)::INT" for i in (1, 2, 3))
_HELD = " + ".join(f"(a.c{i} IS NOT NULL AND b.c{i} IS NOT NULL)::INT" for i in (1, 2, 3))


@query("m7_consensus", f"""WITH {_WIDE}, p AS (SELECT a.id AS i, b.id AS j, {_TOGETHER} AS t, {_HELD} AS n FROM w a JOIN w b ON a.id < b.id)
SELECT i, j, {R('t::DOUBLE / n')} AS "Consensus", n::BIGINT AS "Imputations" FROM p WHERE t > 0""")
def _(spark, d):
    return impute.consensus(_members(spark, d))


@query("m7_consensus_classes", f"""WITH {_WIDE}, k AS MATERIALIZED (SELECT c1, c2, c3, count(*) AS cases, min(id) AS first FROM w GROUP BY c1, c2, c3),
p AS (SELECT a.first AS fa, b.first AS fb, a.cases AS na, b.cases AS nb, {_TOGETHER} AS t, {_HELD} AS n FROM k a JOIN k b ON a.first <= b.first)
SELECT fa AS "First_a", fb AS "First_b", na AS "Cases_a", nb AS "Cases_b", {R('t::DOUBLE / n')} AS "Consensus", n::BIGINT AS "Imputations" FROM p WHERE t > 0""")
def _(spark, d):
    classes, _, pairs = impute.consensus_classes(_members(spark, d))
    side = lambda x: classes.select(F.col("class").alias(x), F.col("First").alias(f"First_{x}"), F.col("Cases").alias(f"Cases_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b")


@query("m8_imputed_cells", f"""{GAPS} SELECT id AS "ID", {MISSING} AS "Original_missing", {R(f'CASE WHEN {MISSING} <= 2 THEN {MISSING} ELSE 0 END')} AS "Imputed_cells" FROM t""")
def _(spark, d):
    t = fx.customers_with_gaps(spark, d)
    copies = impute.mean_impute(t, C, 0.5).withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return impute.imputed_cells(t, copies, C).withColumn("Imputed_cells", F.col("Imputed_cells").cast("double"))


@query("m5_multiple_imputation")
def _(spark, d):
    return impute.multiple_impute(fx.customers_with_gaps(spark, d), C, m=3, sweeps=2)


@query("m5_categorical_imputation")
def _(spark, d):
    """Numbers and text of two and of five values with hashed gaps, completed by matching, logistic and multinomial models."""
    who = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    rows = fx.customers_with_gaps(spark, d).join(who, "id")
    rows = rows.withColumn("side", F.when(F.col("acctbal") + 3000 * key_uniform("side", F.col("id")) > 5000, "high").otherwise("low"))
    hole = lambda v, n: F.when(key_hash("text", F.col("id"), v) % n != 0, F.col(v)).alias(v)
    gaps = rows.select("id", "acctbal", "n_orders", "mean_qty", hole("side", 5), hole("segment", 7))
    return impute.multiple_impute(gaps, ["acctbal", "n_orders", "mean_qty", "side", "segment"], m=3)
