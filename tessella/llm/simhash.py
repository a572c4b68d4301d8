"""SimHash near-dedup: segment-popcount embedding, grid join, exact verification, components.

A fingerprint is cut into 32 segments of 2 bits; its embedding is the bit count of every segment.
The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints
(the counts of a segment differ by at most its differing bits), so it is a safe filter. The counts
are kept in thermometer form (0, 1, 2 -> 00, 01, 11), where the Manhattan distance is a bit count.

Grid range join: the coordinates are divided into ``blocks``; two points within Manhattan distance
``radius`` agree in all but at most ``radius`` blocks, so every choice of ``blocks - radius`` blocks
is a grid whose cells hold the points that agree there, and each close pair meets in some cell.
Pairs of a cell are filtered by Manhattan distance and verified by Hamming distance. All of it runs
on distinct fingerprints: a group of exact copies is one point.

Cells with more than ``cell_cap`` points (large groups of near copies) never list their pairs. Their
points are linked exactly through midpoints: fingerprints at distance 2 or less have a common
neighbour at distance 1 or less from both, and all points around one midpoint are within 2 of each
other, so joining each of them to the smallest keeps every link and invents none. A midpoint has at
most 65 points, so this is linear too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import A_Z, documents, materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
CELL_CAP = 32
_LOWER = str.maketrans(A_Z, A_Z.lower())
#: Chance that two random 2-bit segments have the same bit count.
_SEGMENT_AGREES = 0.375


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the unsigned 64-bit ``hashes``, as one integer."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):  # bounded memory on very long texts
        bits = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned 64-bit integer; zero if it has no word."""
    words = WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    joined = b" ".join(encoded)
    digest = xxhash.xxh64_intdigest
    if len(encoded) <= words_per_shingle:
        hashes = [digest(joined, SEED)]
    else:
        starts = np.cumsum([0, *(len(w) + 1 for w in encoded)]).tolist()
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words_per_shingle:])]
    return majority(np.array(hashes, dtype=np.uint64))


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint ``fp`` as a signed 64-bit integer."""
    return docs.select("doc_id", F.pandas_udf(_fingerprints, "long")("text").alias("fp"))


def thermometer(fp: Column) -> Column:
    """Segment bit counts of ``fp`` in thermometer form, packed into one long."""
    odd = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(half).bitwiseAND(odd), fp.bitwiseAND(half).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def blocks_for(points: int, radius: int = RADIUS) -> int:
    """Number of coordinate blocks that leaves few random companions in a cell: more for more points."""
    blocks = radius + 2
    while blocks < 16 and points * _SEGMENT_AGREES ** (32 * (blocks - radius) / blocks) > 1:
        blocks += 1
    return blocks


def _cell_masks(blocks: int, radius: int) -> list[int]:
    """A mask of kept thermometer bits, as a signed long, for each choice of blocks left out."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(0b11 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(parts) ^ sum(out)) for out in combinations(parts, radius)]


def close_fingerprints(points: DataFrame, cell_cap: int = CELL_CAP, blocks: int | None = None) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs of ``points(fp)`` within 2 bits.

    Every link is a pair within 2 bits. ``points`` holds distinct fingerprints.
    """
    if blocks is None:
        blocks = blocks_for(points.count())
    masks = _cell_masks(blocks, RADIUS)
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("t").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)]))
    placed = points.select("fp", thermometer(F.col("fp")).alias("t")).select("fp", "t", grid.alias("c")).select("c.g", "c.cell", "fp", "t")
    crowded = materialize(placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = placed.join(crowded, ["g", "cell"])

    small = members.where(F.col("n") <= cell_cap)
    left = small.select("g", "cell", F.col("fp").alias("a"), F.col("t").alias("ta"))
    right = small.select("g", "cell", F.col("fp").alias("b"), F.col("t").alias("tb"))
    pairs = left.join(right, ["g", "cell"]).where(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("ta").bitwiseXOR(F.col("tb"))) <= RADIUS)  # Manhattan distance, the lower bound
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )

    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    around = members.where(F.col("n") > cell_cap).select("fp").distinct()
    around = around.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    balls = around.groupBy("mid").agg(F.array_sort(F.collect_list("fp")).alias("near")).where(F.size("near") > 1)
    stars = balls.select(F.element_at("near", 1).alias("a"), F.explode(F.slice("near", 2, 64)).alias("b"))
    return pairs.select("a", "b").unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node of its component.

    Alternating large-star and small-star rounds; the rounds grow with the logarithm of a
    component's size. Minima are pre-aggregated on the map side and written out, so that the join
    that follows has two plain inputs and Spark can split a hub's rows.
    """

    def nearest(edges: DataFrame) -> DataFrame:
        return materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))

    star = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m"))
    while True:
        both = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select(F.col("m").alias("u"), "v"))
        large = both.join(nearest(both), "u").where("v > u").select("v", "m").distinct()
        large = materialize(large)
        down = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = nearest(down)
        small = down.join(lowest, "u").where("v <> m").select("v", "m").unionByName(lowest.select(F.col("u").alias("v"), "m"))
        small = materialize(small.distinct())
        # A forest of stars: nobody is both a leaf and a root, and every leaf has one root.
        stats = small.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("leaves")).first()
        star = small
        if stats["n"] == stats["leaves"] and star.join(star.select(F.col("m").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    return star.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(star.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def near_duplicates(docs: DataFrame, cell_cap: int = CELL_CAP) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, fingerprint, component_id.

    Fingerprints at Hamming distance 2 or less are linked; component_id is the smallest doc_id
    reachable, the row's own included. Null and empty texts have fingerprint zero, linked like any
    other; repeated rows are rows of their own with one fingerprint. A null doc_id counts only if
    its component has no other id. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = materialize(components(close_fingerprints(points.select("fp"), cell_cap)))
    rooted = points.join(found, points["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialize(rooted.join(smallest, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
