"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into 4 segments of 16 bits, each with its own table from segment value to codes.
A search probes the tables at radius 0, then one segment at a time at the next radius, and so on.
Once segments 0..j were probed up to radius r and the others up to r - 1, every code within Hamming
distance 4 r + j has been met (a code farther than that in no segment would differ in more bits).
Distances of codes met are computed exactly, and the search ends when the kth distance is within the
distance covered: the result is then provably the true top k.

On Spark, the distinct codes are dealt into shards and the distinct query codes into blocks. A task
searches one shard for one block and returns each query's best; those are merged per query. The
numbers of shards and blocks grow with the square root of the data, so a task holds a bounded share
and the copies of the index stay far below all pairs. Rows with one code are one point of the search
and expanded at the end, with at most k + 1 ids kept per code: a code that a third of all rows have
costs no more than another.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
K = 10
QUERY_EVERY = 20
SALTS = 16
#: Index codes and query codes of the smallest shard and block.
SHARD, BLOCK = 1024, 64


def sign_code(vector: Column) -> Column:
    """64 bits, bit i set if the sum of the components i, i + 64, i + 128, ... is above zero; null for
    a null or empty vector. Null and NaN components count as zero."""
    clean = F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda i: F.aggregate(F.filter(clean, lambda _, j: j % BITS == i), F.lit(0.0), lambda a, x: a + x),
    )
    bits = F.zip_with(folded, F.sequence(F.lit(0), F.lit(BITS - 1)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    plain = F.zip_with(clean, F.sequence(F.lit(0), F.lit(BITS - 1)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    join = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    return F.when(F.size(vector) == BITS, join(plain)).when(F.size(vector) > 0, join(bits))


class SegmentTables:
    """The multi-index of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.offset = [], []
        for s in range(SEGMENTS):
            value = (codes >> np.uint64(s * WIDTH)).astype(np.uint64) & np.uint64((1 << WIDTH) - 1)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.offset.append(np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)))

    def probe(self, query: int, segment: int, radius: int) -> np.ndarray:
        """Positions of codes whose segment differs from the query's in exactly ``radius`` bits."""
        values = _flips(radius) ^ ((query >> (segment * WIDTH)) & ((1 << WIDTH) - 1))
        start, stop = self.offset[segment][values], self.offset[segment][values + 1]
        hit = stop > start
        start, n = start[hit], (stop - start)[hit]
        if not len(n):
            return np.empty(0, np.int64)
        return self.order[segment][np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def search(self, query: int, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest codes, equal distances by ``rank``."""
        seen = np.empty(0, np.int64)
        met: list[np.ndarray] = []
        distance = np.empty(0, np.int64)
        k = min(k, len(self.codes))
        for radius in range(WIDTH + 1):
            for segment in range(SEGMENTS):
                met.append(self.probe(query, segment, radius))
                if sum(map(len, met)) + len(seen) < k:
                    continue
                if sum(map(len, met)):
                    seen = np.unique(np.concatenate([seen, *met]))
                    distance = np.bitwise_count(self.codes[seen] ^ np.uint64(query)).astype(np.int64)
                    met = []
                covered = SEGMENTS * radius + segment
                if len(seen) >= k and np.count_nonzero(distance <= covered) >= k:
                    near = np.flatnonzero(distance <= covered)
                    best = near[np.lexsort((rank[seen[near]], distance[near]))[:k]]
                    return seen[best], distance[best]
        best = np.lexsort((rank[seen], distance))[:k]
        return seen[best], distance[best]


_FLIPS: dict[int, np.ndarray] = {}


def _flips(radius: int) -> np.ndarray:
    if radius not in _FLIPS:
        _FLIPS[radius] = np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)], np.int64)
    return _FLIPS[radius]


def _parts(n: int, smallest: int) -> int:
    return max(1, math.ceil(math.sqrt(n / smallest)))


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, code, distance): the k nearest of ``codes(code, first_id)`` for each of ``queries(code)``.

    Both hold distinct codes; equal distances go to the smaller first_id, null first.
    """
    shards, blocks = _parts(codes.count(), SHARD), _parts(queries.count(), BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = codes.select("code", "first_id", F.pmod(F.hash("code"), F.lit(shards)).alias("shard"), every(blocks).alias("block"))
    asked = queries.select(F.col("code").alias("query"), F.pmod(F.hash("code"), F.lit(blocks)).alias("block"), every(shards).alias("shard"))

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(asked):
            tables = SegmentTables(index["code"].to_numpy(np.int64).view(np.uint64))
            rank = index["first_id"].fillna(-(1 << 63)).to_numpy(np.int64)
            for q in asked["query"].to_numpy(np.int64):
                at, distance = tables.search(int(q) & ((1 << BITS) - 1), rank, k)
                out.append(pd.DataFrame({"query": q, "code": index["code"].to_numpy()[at], "first_id": rank[at], "distance": distance}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "code": [], "first_id": [], "distance": []}, dtype="int64")

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "query bigint, code bigint, first_id bigint, distance bigint")
    best = Window.partitionBy("query").orderBy("distance", "first_id", "code")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("query", "code", "distance")


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(id, rank, neighbour_id, distance): the k nearest rows of ``codes(id, code)`` for each row of
    ``queries(id, code)``, itself left out; equal distances by neighbour_id.

    Rows with a null code or id are neither found nor answered. Repeated rows are one row. With fewer
    than k other rows, all of them are returned. Empty tables give an empty result. Other columns are
    ignored, whatever their names.
    """
    known = codes.where("code is not null and id is not null").select("id", "code")
    asked = materialize(queries.where("code is not null and id is not null").select("id", "code").distinct())
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    # The k + 1 smallest ids of a code, first within salted parts of it.
    least = known.select("id", "code", salt).distinct().withColumn("_r", rank("code", "salt")).where(F.col("_r") <= k + 1)
    least = least.withColumn("_r", rank("code")).where(F.col("_r") <= k + 1)
    points = materialize(least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    near = nearest_codes(points.select("code", F.col("ids")[0].alias("first_id")), asked.select("code").distinct(), k + 1)
    pairs = near.join(points, "code").select("query", F.explode("ids").alias("neighbour_id"), "distance")
    lists = pairs.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("found"))
    lists = materialize(lists.select("query", F.slice("found", 1, k + 1).alias("found")))
    answers = asked.join(lists, asked["code"] == lists["query"]).select("id", F.filter("found", lambda x: x["neighbour_id"] != F.col("id")).alias("found"))
    return answers.select("id", F.posexplode(F.slice("found", 1, k)).alias("pos", "hit")).select(
        "id", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("hit.neighbour_id").alias("neighbour_id"), F.col("hit.distance").alias("distance")
    )


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = materialize(rows.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")))
    return top_k(codes, codes.where(F.col("id") % QUERY_EVERY == 0)).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH c AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT::UBIGINT AS code FROM embeddings),
d AS (SELECT q.vec_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code)::BIT)::BIGINT AS distance
      FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank, neighbour_id, distance
FROM d QUALIFY rank <= 10
"""
