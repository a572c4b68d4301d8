"""Near copies by five-word shingles: SimHash links, and an exact prefix filter for all others.

The documents that operator 8's method brings together (fingerprints of the five-word shingles, segment
bit counts, grid join, two bits) are candidates first. But at a similarity of 0.8 fingerprints differ
by about ten bits, so the other candidates come from the shingles themselves. All shingles have one
global order. Two sets of similarity 0.8 share at least 0.8 / 1.8 of their summed sizes, so the first
shingle they share stands within the first fifth of both, and its positions bound what they can share
after it. Documents meet in the bucket of each shingle of their prefix and every pair that sizes and
positions allow is verified by the exact similarity of the two sets. No pair is lost: the order decides
how many candidates there are, not which links are found.

The order is that of the hashes, with frequent shingles last. Which those are follows from exact counts:
shingles that more than ``pair_cap`` documents hold near their prefix are put behind all others, the most
frequent last, and the prefixes that this leaves too short are drawn anew, once: how often the table is read
does not depend on what it holds. So a passage that many documents share leads to no bucket unless a
document consists of such passages.

Buckets with the same members are one bucket, at their first shingle. Buckets of up to ``pair_cap``
documents list their pairs. In larger ones the documents meet a leader, and then only documents that
are not yet in one component matter: leaders follow each other until a round no longer halves what is
open, or little is open, and then all open pairs are compared. So links have the components of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize, one_row_each, text_batches
from tessella.llm.simhash import SEED, WORD, _LOWER, close_fingerprints, components, majority
from tessella.session import scratch

WORDS = 5
SIMILARITY = 0.8
PAIR_CAP = 16
#: All open pairs of large buckets are compared at once if there are at most so many per place in a bucket.
OPEN_PAIRS = 4 * PAIR_CAP
#: So many frequent shingles at most are sent to all tasks; more of them are joined.
SENT_KEYS = 1_000_000
#: Rows that a Python task works on at a time.
PIECE = 500
#: Bits of a shingle's hash in its place in the order; above them is its level, 0 unless it is frequent.
_HASH_BITS = 57
_EPS = 1e-9


def shingle_hashes(text: str | None, words_per_shingle: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles of ``text``, in order; a text without words has one, zero."""
    words = WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.zeros(1, dtype=np.uint64)
    known = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in set(words)}
    single = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    count = max(1, len(single) - words_per_shingle + 1)
    mixed = np.zeros(count, dtype=np.uint64)
    for k in range(min(words_per_shingle, len(single))):
        mixed = (mixed ^ single[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _places(hashes: np.ndarray) -> np.ndarray:
    """Places of sorted hashes in the order in which no shingle is frequent."""
    return (hashes >> np.uint64(64 - _HASH_BITS)).view(np.int64)


def _sketched(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                h = np.unique(shingle_hashes(text))
                reach = _places(h[: 2 * (len(h) - int(np.ceil(similarity * len(h) - _EPS)) + 1)])
                fp = majority(h)
                rows.append((doc, len(h), _digest(h), fp - (1 << 64) if fp >> 63 else fp, reach))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "fp", "reach"])

    return run


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of the batches, few at a time: what is made of them is as large as their texts."""
    for pdf in batches:
        for i in range(0, len(pdf), PIECE):
            yield pdf.iloc[i : i + PIECE]


def _sketches(docs: DataFrame, similarity: float) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInPandas(_sketched(similarity), f"doc_id {kind}, n int, digest binary, fp bigint, reach array<bigint>")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _pieces(batches):
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "s": [np.unique(shingle_hashes(t)).view(np.int64) for t in pdf["text"]]})


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, s) of the documents in ``ids(doc_id)``: their distinct shingles."""
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return texts.mapInPandas(_sets, f"doc_id {dict(docs.dtypes)['doc_id']}, s array<bigint>")


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sizes and prefixes allow that similarity.

    Up to the smaller of the last shingles of both prefixes, all common shingles are seen; beyond it there are
    at most as many as the smaller rest holds. One is added for shingles that share a place.
    """
    taking_part = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    own = sketches.join(taking_part, "doc_id", "left_semi")
    of = lambda x: own.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("_last", F.least(F.element_at("pa", -1), F.element_at("pb", -1)))
    rest = lambda x: F.col(f"n{x}") - F.size(F.filter(f"p{x}", lambda v: v <= F.col("_last")))
    most = F.size(F.array_intersect("pa", "pb")) + F.least(rest("a"), rest("b")) + 1
    return both.where(most >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - _EPS).select("a", "b")


def verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose texts' shingle sets have at least that Jaccard similarity."""
    pairs = materialize(plausible(pairs, sketches, similarity))
    taking_part = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = materialize(sets_of(docs, materialize(taking_part)))
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))


def _prefix_length(similarity: float) -> Column:
    return (F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - _EPS) + 1).cast("int")


def _placed(sketches: DataFrame, places: str = "prefix") -> DataFrame:
    return sketches.select("doc_id", "n", F.posexplode(places).alias("i", "key"))


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"))


def _without(keys: np.ndarray):
    """Removes the sorted ``keys`` from arrays of places."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            out = []
            for x in arrays:
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                out.append(x[keys[at] != x])
            yield pd.Series(out)

    return run


def _less_frequent(sketches: DataFrame, frequent: DataFrame) -> DataFrame:
    """``sketches`` with frequent shingles taken from ``reach``: by a list sent to all tasks up to ``SENT_KEYS``
    shingles, else by a join."""
    if frequent.count() <= SENT_KEYS:
        keys = np.sort(frequent.select("key").toPandas()["key"].to_numpy(np.int64))
        return sketches.withColumn("reach", F.pandas_udf(_without(keys), "array<bigint>")("reach"))
    hits = _placed(sketches, "reach").join(frequent, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("_hits"))
    met = sketches.join(hits, "doc_id", "left")
    return met.withColumn("reach", F.when(F.col("_hits").isNull(), F.col("reach")).otherwise(F.array_except("reach", "_hits"))).drop("_hits")


def _all_places(sets: DataFrame) -> DataFrame:
    return sets.select("doc_id", F.explode(F.transform("s", lambda h: F.shiftrightunsigned(h, 64 - _HASH_BITS))).alias("key"))


def _drawn(sets: DataFrame, sketches: DataFrame, frequent: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``sketches`` of the documents in ``sets(doc_id, s)``, with prefixes drawn from their whole sets."""
    place = F.col("key") + F.shiftleft(F.coalesce("level", F.lit(0)).cast("bigint"), _HASH_BITS)
    drawn = _all_places(sets).join(frequent, "key", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(place)).alias("_all"))
    own = sketches.join(sets.select("doc_id"), "doc_id", "left_semi").join(drawn, "doc_id")
    return own.withColumn("prefix", F.slice("_all", F.lit(1), _prefix_length(similarity))).drop("_all")


def _frequency_level() -> Column:
    return F.least(F.lit(63), F.floor(3 * F.log2("c"))).cast("int").alias("level")


def _first_order(sketches: DataFrame, cap: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(``sketches(doc_id, n, fp, reach)`` with ``prefix`` instead of ``reach``, the frequent shingles (key, level)).

    ``reach`` is twice as long as the prefix. A shingle within the reach of more than ``cap`` documents is
    frequent; what is left of the reach has the prefix, as a rule.
    """
    frequent = materialize(_counted(_placed(sketches, "reach")).where(F.col("c") > cap).select("key", _frequency_level()))
    if not frequent.isEmpty():
        sketches = _less_frequent(sketches, frequent)
    return sketches.select("doc_id", "n", "fp", F.slice("reach", F.lit(1), _prefix_length(similarity)).alias("prefix")), frequent


def _frequent_last(sketches: DataFrame, frequent: DataFrame, docs: DataFrame, cap: int, similarity: float) -> DataFrame:
    """``sketches`` with whole prefixes in the order with frequent shingles last.

    Where the reach left too little, the prefix is drawn from the whole text. Shingles of more than ``cap`` of
    those texts are frequent too, and as the order is one for all documents, whoever has one of them in the prefix
    gets a new one. That is done once: the passes over the table are the same for any input.
    """
    short = materialize(sketches.where(F.size("prefix") < _prefix_length(similarity)).select("doc_id"))
    if short.isEmpty():
        return sketches
    sets = materialize(sets_of(docs, short))
    crowded = _counted(_all_places(sets)).where(F.col("c") > cap).select("key", _frequency_level())
    new = materialize(crowded.join(frequent, "key", "left_anti"))
    whole = sketches.join(short, "doc_id", "left_anti")
    met = materialize(_placed(whole).join(new, "key", "left_semi").select("doc_id").distinct())
    sets = sets.unionByName(materialize(sets_of(docs, met)))
    changed = materialize(_drawn(sets, sketches, frequent.unionByName(new), similarity))
    return whole.join(met, "doc_id", "left_anti").unionByName(changed)


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether sizes n and positions i in a bucket at the first common shingle allow the similarity."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (nx + ny) - _EPS)
    return (F.least(nx, ny) >= F.lit(similarity) * F.greatest(nx, ny) - _EPS) & (nx - F.col(f"{x}.i") >= least) & (ny - F.col(f"{y}.i") >= least)


def _sorted_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))


def _met(large: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the members of large buckets with their bucket's leader ``leaders(key, doc_id, n, i, root)``."""
    met = large.alias("x").join(leaders.alias("y"), F.col("x.key") == F.col("y.key"))
    return _sorted_pairs(met.where((F.col("x.root") != F.col("y.root")) & _possible("x", "y", similarity)))


def _leaders(large: DataFrame, rank: Column) -> DataFrame:
    top = F.max_by(F.struct("doc_id", "n", "i", "root"), F.struct(rank, "doc_id")).alias("top")
    return materialize(large.groupBy("key").agg(top).select("key", "top.*"))


def _rooted(large: DataFrame, links: DataFrame) -> DataFrame:
    """``large`` with the roots of ``root`` in the components of ``links(a, b)``, which are links of such roots."""
    tops = materialize(components(links)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(large.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"))


def _simhash_candidates(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of documents whose fingerprints are alike or within two bits, by operator 8's method:
    each document with the first of its fingerprint, and the first ones of close fingerprints."""
    points = materialize(sketches.groupBy("fp").agg(F.min("doc_id").alias("first")))
    same = sketches.join(points, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    of = lambda x: points.select(F.col("fp").alias(x), F.col("first").alias(f"f{x}"))
    close = close_fingerprints(points.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(close.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")))


def _ordered(named: DataFrame, cap: int, similarity: float, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``sketches(doc_id, n, fp, prefix)`` of one document of each large class of equal sets, the links (a, b) of the
    others to it, the documents with one row for each doc_id), written by ``keep``."""
    with scratch(named.sparkSession) as keep_order:
        sketches = materialize(_sketches(named, similarity))
        if not sketches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
            named = keep(named.groupBy("doc_id").agg(F.min("text").alias("text")))
            sketches = materialize(_sketches(named, similarity))

        # Of many equal sets the first stands for all.
        classes = sketches.groupBy("digest").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("first")).where(F.col("m") > cap)
        equal = sketches.select("doc_id", "digest").join(materialize(classes), "digest").where("doc_id <> first")
        equal = keep(equal.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
        alone = sketches.join(equal.select(F.col("b").alias("doc_id")), "doc_id", "left_anti").drop("digest")
        alone, frequent = (keep_order(df) for df in _first_order(alone, cap, similarity))
    return keep(_frequent_last(alone, frequent, named, cap, similarity)), equal, named


def near_copy_links(docs: DataFrame, similarity: float = SIMILARITY, pair_cap: int = PAIR_CAP) -> DataFrame:
    """Links (a, b), a < b, between documents of ``docs(doc_id, text, ...)`` of at least that similarity.

    Their components are those of all such pairs; pairs that meet in no bucket of more than
    ``pair_cap`` documents are all there. Every link is verified on whole texts. Rows without doc_id
    take no part; of rows with one doc_id one does. Null and empty texts are alike, as are equal texts.
    No documents give no links.
    """
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    text_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        alone, equal, named = _ordered(named, pair_cap, similarity, keep)
    close = materialize(_simhash_candidates(alone.select("doc_id", "fp")).distinct())

    placed = _placed(alone)
    shared = materialize(_counted(placed).where("c > 1"))
    members = materialize(placed.join(shared, "key").withColumn("root", F.col("doc_id")))
    who = [F.bit_xor(F.xxhash64("doc_id", F.lit(seed))).alias(f"w{seed}") for seed in (1, 2)]
    buckets = members.groupBy("key").agg(F.first("c").alias("c"), *who).groupBy("c", "w1", "w2").agg(F.min("key").alias("key"))
    members = materialize(members.join(materialize(buckets.select("key")), "key", "left_semi"))
    small = members.where(F.col("c") <= pair_cap)
    listed = small.alias("x").join(small.alias("y"), F.col("x.key") == F.col("y.key"))
    listed = _sorted_pairs(listed.where((F.col("x.doc_id") < F.col("y.doc_id")) & _possible("x", "y", similarity)))
    listed = materialize(listed.union(close).distinct())
    large = materialize(members.where(F.col("c") > pair_cap))
    found = [equal, verified(listed, alone, named, similarity)]

    company = materialize(large.groupBy("doc_id").agg(F.sum("c").alias("company")))
    large = large.join(company, "doc_id")
    open_before = None
    if not large.isEmpty():
        large = _rooted(large, materialize(reduce(DataFrame.union, found)))
    while not large.isEmpty():
        parts = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
        main = parts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("size"), F.sum("size").alias("c")).where("size < c")
        main = materialize(main)
        work = main.agg(F.sum("c").alias("places"), F.sum((F.col("c") - F.col("size")) * F.col("c")).alias("pairs")).first()
        if not work["places"]:
            break
        large = materialize(large.join(main.select("key", "main"), "key"))
        every = work["pairs"] <= OPEN_PAIRS * work["places"] or (open_before is not None and work["pairs"] > open_before / 2)
        if every:
            rest = large.where("root <> main").alias("x").join(large.alias("y"), F.col("x.key") == F.col("y.key"))
            candidates = _sorted_pairs(rest.where((F.col("x.root") != F.col("y.root")) & _possible("x", "y", similarity)))
        else:
            rank = F.col("company") if open_before is None else F.xxhash64("doc_id", F.lit(len(found)))
            candidates = _met(large, _leaders(large, rank), similarity)
        open_before = work["pairs"]
        found.append(verified(materialize(candidates.distinct()), alone, named, similarity))
        if every:
            break
        roots = materialize(large.select("doc_id", "root").distinct())
        of = lambda x: roots.select(F.col("doc_id").alias(x), F.col("root").alias(f"r{x}"))
        between = found[-1].join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        large = _rooted(large.drop("main"), materialize(between.where("a <> b").distinct()))
    return reduce(DataFrame.union, found).distinct()


def near_copy_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the smallest doc_id of its group."""
    with scratch(docs.sparkSession) as keep:
        found = components(materialize(near_copy_links(docs, similarity)))
        return keep(found.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id")))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies, with the columns of documents.

    Of rows with one doc_id one stays, the same one in every run; a row without doc_id goes. Columns
    beyond doc_id and text are carried along, whatever their names. Texts are compared whole.
    """
    copies = near_copy_groups(docs).where("doc_id <> group_id").select("doc_id")
    return one_row_each(docs.where(F.col("doc_id").isNotNull()).join(copies, "doc_id", "left_anti"), "doc_id")
