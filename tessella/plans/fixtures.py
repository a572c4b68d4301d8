"""Case tables derived from the driver's tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import key_hash

CUSTOMER = ["acctbal", "n_orders", "mean_price", "mean_qty", "mean_disc"]
GAPS = ["n_orders", "mean_qty", "mean_disc"]
FLAGS = ["f1", "f2", "f3", "f4", "f5"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and five features of every customer with an order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount")
    # Summed per order first, so that the join with orders moves one row per order.
    per_order = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(c) for c in items.columns[1:]])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_customer = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), *[(F.sum(c) / F.sum("k")).alias(a) for c, a in zip(items.columns[1:], CUSTOMER[2:])]
    )
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("acctbal"))
    return who.join(per_customer, F.col("id") == F.col("o_custkey")).select("id", *CUSTOMER)


CUSTOMERS_SQL = """
SELECT c_custkey AS id, c_acctbal::DOUBLE AS acctbal, count(DISTINCT o_orderkey)::DOUBLE AS n_orders,
       avg(l_extendedprice) AS mean_price, avg(l_quantity) AS mean_qty, avg(l_discount) AS mean_disc
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey, c_acctbal"""


def customers_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = {v: F.when(key_hash("F3", F.col("id"), v) % 9 != 0, F.col(v)) for v in GAPS}
    return customers(spark, sf_dir).withColumns(holes)


_HOLE = "CASE WHEN ('0x' || substr(md5('F3|' || id::VARCHAR || '|{v}'), 1, 15))::BIGINT % 9 <> 0 THEN {v} END AS {v}"
GAPS_SQL = f"SELECT id, acctbal, {_HOLE.format(v='n_orders')}, mean_price, {_HOLE.format(v='mean_qty')}, {_HOLE.format(v='mean_disc')} FROM ({CUSTOMERS_SQL})"


def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("id")).agg(*[F.count_if(F.col("o_orderpriority") == p).cast("double").alias(f"p{i + 1}") for i, p in enumerate(PRIORITIES)])


COUNTS_SQL = "SELECT o_custkey AS id, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}')::DOUBLE AS p{i + 1}" for i, p in enumerate(PRIORITIES)) + " FROM orders GROUP BY o_custkey"


def priority_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five 0/1 variables of every customer: three or more orders of a priority."""
    counts = priority_counts(spark, sf_dir)
    return counts.select("id", *[(F.col(f"p{i + 1}") >= 3).cast("double").alias(f) for i, f in enumerate(FLAGS)])


FLAGS_SQL = "SELECT id, " + ", ".join(f"(p{i + 1} >= 3)::INT::DOUBLE AS {f}" for i, f in enumerate(FLAGS)) + f" FROM ({COUNTS_SQL})"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, mean_total, n_orders, building (0/1), last_priority (1 to 5)."""
    orders = table(spark, sf_dir, "orders")
    last = F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey"))
    per = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_total"), F.count(F.lit(1)).cast("double").alias("n_orders"), F.substring(last, 1, 1).cast("double").alias("last_priority"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"))
    return who.join(per, F.col("id") == F.col("o_custkey")).select("id", "mean_total", "n_orders", "building", "last_priority")


MIXED_SQL = """
SELECT c_custkey AS id, mean_total, n_orders, (c_mktsegment = 'BUILDING')::INT::DOUBLE AS building, last_priority
FROM customer JOIN (SELECT o_custkey, avg(o_totalprice) AS mean_total, count(*)::DOUBLE AS n_orders,
                           substr(arg_max(o_orderpriority, (o_orderdate, o_orderkey)), 1, 1)::DOUBLE AS last_priority FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, label of the embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").alias("cluster"))


VECTORS_SQL = "SELECT vec_id AS id, embedding::DOUBLE[] AS x, label AS cluster FROM embeddings"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))


PARTS_SQL = "SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price FROM part"


def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written as 112.946,26 and a code with leading zeros."""
    price = F.format_number("o_totalprice", 2)
    swapped = F.translate(price, ".,", ",.")
    return table(spark, sf_dir, "orders").select("o_orderkey", swapped.alias("s"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("code"))


def hashed_partition(df: DataFrame, k: int = 4, salt: str = "part") -> DataFrame:
    """A fixed partition that owes nothing to the data."""
    return df.withColumn("cluster", (key_hash(salt, F.col("id")) % k + 1).cast("int"))


def hashed_sql(sql: str, k: int = 4, salt: str = "part") -> str:
    return f"SELECT *, (('0x' || substr(md5('{salt}|' || id::VARCHAR), 1, 15))::BIGINT % {k} + 1)::INT AS cluster FROM ({sql})"
