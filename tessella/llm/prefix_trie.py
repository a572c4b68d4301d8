"""A trie of conversation prefixes by vertical bitmaps.

Conversations are dealt into shards by ranges of conv_id. In a shard, the nth conversation is bit n, and every (position,
turn) has the bitset of the conversations with that turn at that place. A depth-first walk starts with all bits: the
lowest bit left of a node names a turn at the next position, and the node's bitset cut with that turn's is a child;
the bits without a next turn are the conversations that end here. A popcount gives the size of a node in its shard, the
lowest bit its smallest conversation, and the bits of the ends, in order, their list.

Nodes of the shards are merged by their path, of which a shard gives one row each, however many conversations
share it. Sums over subtrees need every node once: each node is counted by its owner, the shard of its smallest
conversation, which adds up its own nodes bottom-up along its walk; the sums of the shards are then added. The lists of
ends, which may be long, are never put together: their parts follow each other by shard through a running digest.

Turns and paths are named by the first 128 bits of SHA-256 digests of their whole content.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize

#: Conversations in a shard (bits of a bitset), and turns of a task's range of conversations.
SHARD, RANGE_TURNS = 4096, 200_000
#: A parent is hot if it has more than ``HOT_LEAST`` children and more than one in ``HOT_SHARE`` of all nodes.
HOT_LEAST, HOT_SHARE = 100, 10_000
WORD = r"[^\x20\x09-\x0D]+"
BLOCK, BORROWED = 20, 4
ROOT = bytes(16)
LOCAL = "shard bigint, path binary, parent binary, depth int, n bigint, conv_id bigint, words bigint, ends binary"


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of a turn: the length of the role keeps (role, text) apart from other cuts of the same characters."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words) of ``rows(conv_id, turn, role, text, ...)``: pos counts from 0 by turn, null first; equal
    turns by role, then text. Null role and text are empty; repeated rows are turns of their own; rows with a null
    conv_id belong to no conversation and are left out."""
    clean = rows.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Texts are moved once, here, as equal turn numbers are ordered by them; from here on a turn is its digest.
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return clean.withColumn("pos", F.row_number().over(order) - 1).select(
        "conv_id", "pos", turn_key(F.col("role"), F.col("text")).alias("key"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")
    )


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes over: the unsigned CRC-32 of its decimal number modulo 4."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(BORROWED)).cast("int")


def with_shared_openings(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, pos, key, words)`` rebuilt: each conversation c starts with the first h turns of conversation c - c % 20
    (all if there are fewer, none if it is absent), h = ``borrowed(c)``, followed by its own turns but for the first h.

    The result has (conv_id, part, pos, key, words): part -1 stands for the conversation itself (pos, key and words null), 0
    for borrowed turns and 1 for its own; a conversation's turns are in order of part and pos. A conversation lends at most
    three turns to at most 20 others, so no key of the join is hot.
    """
    convs = turns.where("pos = 0").select("conv_id", borrowed(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    lent = turns.where(f"pos < {BORROWED - 1} and conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("base"), "pos", "key", "words")
    first = convs.join(lent, "base").where("pos < h").select("conv_id", F.lit(0).alias("part"), "pos", "key", "words")
    own = turns.where(F.col("pos") >= borrowed(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "pos", "key", "words")
    itself = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("bigint").alias("words"))
    return itself.unionByName(first).unionByName(own)


def _walk(ids: list[int], convs: list[list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """(path, parent, depth, n, smallest id, words, ends) of every node of a shard, parents before their children."""
    postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, convs), default=0))]
    longer = [0] * (len(postings) + 1)  # conversations with more than d turns
    for at, turns in enumerate(convs):
        bit = 1 << at
        for pos, (key, _) in enumerate(turns):
            postings[pos][key] = postings[pos].get(key, 0) | bit
            longer[pos] |= bit
    stack = [(ROOT, ROOT, 0, (1 << len(ids)) - 1, 0)]
    while stack:
        path, parent, depth, bits, words = stack.pop()
        ends, rest = bits & ~longer[depth], bits & longer[depth]
        low = (bits & -bits).bit_length() - 1
        yield path, parent, depth, bits.bit_count(), ids[low], words, _members(ends, ids)
        while rest:
            at = (rest & -rest).bit_length() - 1
            key, count = convs[at][depth]
            child = bits & postings[depth][key]
            rest &= ~child
            stack.append((hashlib.sha256(path + key).digest()[:16], path, depth + 1, child, count))


def _members(bits: int, ids: list[int]) -> bytes | None:
    """The ids of a bitset, ascending, as 64-bit numbers."""
    if not bits:
        return None
    flags = np.unpackbits(np.frombuffer(bits.to_bytes(len(ids) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.asarray(ids, np.int64)[np.flatnonzero(flags)].tobytes()


def shard_nodes(rebuilt: DataFrame, shard: int = SHARD, range_turns: int = RANGE_TURNS) -> DataFrame:
    """Nodes of all shards, written: shard (its smallest conv_id), path, parent, depth, n, conv_id, words (of the last turn), ends."""
    parts = max(1, rebuilt.count() // range_turns)
    parts = max(parts, int(rebuilt.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def nodes(ids: list[int], convs: list[list[tuple[bytes, int]]]) -> pd.DataFrame:
        made = pd.DataFrame(list(_walk(ids, convs)), columns=["path", "parent", "depth", "n", "conv_id", "words", "ends"])
        made.insert(0, "shard", ids[0])
        return made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        convs: list[list[tuple[bytes, int]]] = []
        for pdf in batches:
            for conv, part, key, words in zip(pdf["conv_id"], pdf["part"], pdf["key"], pdf["words"]):
                if part < 0:
                    if len(ids) == shard:
                        yield nodes(ids, convs)
                        ids, convs = [], []
                    ids.append(int(conv))
                    convs.append([])
                else:
                    convs[-1].append((bytes(key), int(words)))
        if ids:
            yield nodes(ids, convs)

    dealt = rebuilt.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return materialize(dealt.select("conv_id", "part", "key", "words").mapInPandas(run, LOCAL))


def merged_nodes(local: DataFrame) -> DataFrame:
    """The nodes of all shards by path: path, parent, depth, conv_id, n_convs, n_children, saved (of the node alone), owner."""
    one = local.groupBy("path").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.min("shard").alias("owner"),
    )
    one = materialize(one)
    children = one.where("depth > 0").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    met = one.join(children, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    return materialize(met.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id, the smallest conversation of the parent. Parents of more than one in ``HOT_SHARE`` nodes,
    of which there are fewer than ``HOT_SHARE``, are sent to all tasks; the children of others meet theirs by a join."""
    most = max(HOT_LEAST, nodes.count() // HOT_SHARE)
    inner = nodes.where("n_children > 0").select(F.col("path").alias("parent"), F.col("conv_id"), (F.col("n_children") > most).alias("hot"))
    hot = F.broadcast(inner.where("hot").select("parent", F.col("conv_id").alias("_hot")))
    cold = inner.where("not hot").select(F.col("parent").alias("_parent"), F.col("conv_id").alias("_cold"))
    met = nodes.join(hot, "parent", "left").withColumn("_parent", F.when(F.col("_hot").isNull(), F.col("parent")).otherwise(F.col("path")))
    return met.join(cold, "_parent", "left").withColumn("parent_conv_id", F.coalesce("_hot", "_cold")).drop("_parent", "_hot", "_cold")


def subtree_sums(local: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, n_leaves, saved_tokens): sums over subtrees, by the shards that own the nodes."""
    own = nodes.select("path", F.col("owner").alias("shard"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), "saved")
    marked = local.select("shard", "path", "parent", "depth").join(own, ["shard", "path"], "left").na.fill(0, ["leaves", "saved"])

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth", ignore_index=True)
        place = {p: i for i, p in enumerate(map(bytes, pdf["path"]))}
        up = np.array([place[bytes(p)] for p in pdf["parent"]], np.int64)
        sums = pdf[["leaves", "saved"]].to_numpy(np.int64).copy()
        cuts = np.flatnonzero(np.diff(pdf["depth"].to_numpy())) + 1
        for level in reversed(np.split(np.arange(len(pdf)), cuts)[1:]):
            np.add.at(sums, up[level], sums[level])
        some = sums.any(axis=1)
        return pd.DataFrame({"path": pdf["path"][some], "leaves": sums[some, 0], "saved": sums[some, 1]})

    sums = marked.groupBy("shard").applyInPandas(add_up, "path binary, leaves bigint, saved bigint")
    return sums.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_digests(local: DataFrame) -> DataFrame:
    """(path, ends_sha256): SHA-256 of the decimal numbers of the conversations that end at a node, ascending, with commas
    between. The parts of a node's list come to one task in order of shard and pass through a running digest: a task
    holds one part (at most a shard's conversations) at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            out = []
            for path, ends in zip(pdf["path"], pdf["ends"]):
                text = ",".join(map(str, np.frombuffer(ends, np.int64))).encode()
                if path != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = path, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            yield pd.DataFrame(out, columns=["path", "ends_sha256"])
        if digest is not None:
            yield pd.DataFrame({"path": [now], "ends_sha256": [digest.hexdigest()]})

    parts = local.where("ends is not null").select("path", "shard", "ends").repartition("path").sortWithinPartitions("path", "shard")
    return parts.mapInPandas(run, "path binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``rebuilt(conv_id, part, pos, key, words)`` (see ``with_shared_openings``).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (of the subtree: each node's members but one, times the words of its last turn), ends_sha256.
    Equal conversations share all their nodes and end at one. Without conversations there is no node, not even a root.
    """
    local = shard_nodes(rebuilt, shard)
    nodes = merged_nodes(local)
    none = hashlib.sha256(b"").hexdigest()
    met = with_parents(nodes).join(subtree_sums(local, nodes), "path", "left").join(end_digests(local), "path", "left")
    return met.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0).cast("bigint")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("bigint")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(with_shared_openings(materialize(numbered_turns(rows))))


# The unsigned CRC-32 of a text bit by bit: each byte goes in, then eight shifts (-1).
_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length({0})),
  lambda i: [ascii(substr({0}, (i + 1)::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""
ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                  {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS u FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC.format("conv_id::VARCHAR")}, 4294967295) % 4 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.u FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.u FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
l AS (SELECT c.conv_id, coalesce(x.seq, []) AS seq FROM c LEFT JOIN (SELECT conv_id, list(u ORDER BY part, pos) AS seq FROM r GROUP BY conv_id) x USING (conv_id)),
p AS (SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq FROM l),
n AS (SELECT seq[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
      FROM p GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS saved,
             NOT EXISTS (SELECT 1 FROM n m WHERE m.depth = n.depth + 1 AND m.path[1:n.depth] = n.path) AS leaf FROM n)
SELECT w.conv_id, w.depth, (SELECT m.conv_id FROM n m WHERE m.depth = w.depth - 1 AND m.path = w.path[1:w.depth - 1]) AS parent_conv_id, w.n_convs,
       count(*) FILTER (WHERE s.depth = w.depth + 1) AS n_children, count(*) FILTER (WHERE s.leaf) AS n_leaves,
       sum(s.saved)::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN w s ON s.depth >= w.depth AND s.path[1:w.depth] = w.path
GROUP BY w.conv_id, w.depth, w.path, w.n_convs, w.ends_sha256
"""
