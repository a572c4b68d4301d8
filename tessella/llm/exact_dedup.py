"""Exact dedup: skew-safe combining of salted digest groups, DataFrame functions only.

1. Locally: Spark's map-side aggregation merges equal texts within a partition.
2. Salted: the key is (digest, salt, text). Digests of more than one row in ``HOT_SHARE`` (of which there are
   fewer than ``HOT_SHARE``, so their list is sent to all tasks) are spread over ``salts`` tasks; the other
   digests have one salt.
3. Globally: the salt winners of a text are combined on (digest, text). For a digest with one salt only the
   number of its texts is checked, so its text is not moved again.

The whole text is part of the key wherever rows are merged, so a digest collision never merges two texts.
The winner goes back to the documents on (digest, salt): the rows of a hot group meet it in ``salts``
different tasks. That lookup relies on one text per digest, which the global stage has checked by
content: two texts under one SHA-256 digest stop the job instead of giving a wrong group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, lower_ascii, materialize, one_row_each

MAX_SALTS = 64
#: A digest is hot if it has more than ``HOT_LEAST`` rows and more than one in ``HOT_SHARE`` of all.
HOT_LEAST, HOT_SHARE = 100, 10_000


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def exact_dedup(docs: DataFrame, salts: int = MAX_SALTS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id of a group stays.
    A null text counts as empty. A null doc_id is the smallest; if a group has no other, keep_id is
    null. Repeated rows are rows of their own: group_size counts them all, and each copy of the
    winning row is kept. An empty table gives an empty result. Other columns are ignored. Texts of any
    length are compared whole.
    """
    if not 1 <= salts <= MAX_SALTS:
        raise ValueError(f"salts must be 1..{MAX_SALTS}")
    rows = docs.select("doc_id", normalised(F.col("text")).alias("_text")).withColumn("_sha", F.sha2("_text", 256))
    short = materialize(rows.select("doc_id", "_sha", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("_any")))
    least = max(HOT_LEAST, short.count() // HOT_SHARE)
    hot = materialize(short.groupBy("_sha").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > least).select("_sha", F.lit(True).alias("_hot")))
    marked = lambda df: df.join(F.broadcast(hot), "_sha", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))

    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(0)
    salted = marked(rows).withColumn("_salt", dealt).groupBy("_sha", "_hot", "_salt", "_text").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    whole = F.when(F.col("_hot"), F.col("_text")).alias("_text")
    winners = salted.groupBy("_sha", "_hot", whole).agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_parts"))
    texts = F.sum(F.when(F.col("_hot"), 1).otherwise(F.col("_parts")))  # a digest with one salt has a part per text
    by_digest = winners.groupBy("_sha", "_hot").agg(texts.alias("_texts"), F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    two_texts = F.raise_error(F.concat(F.lit("two different texts share SHA-256 digest "), F.col("_sha")))
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    placed = by_digest.select("_sha", F.when(F.col("_texts") > 1, two_texts.cast("bigint")).otherwise(F.col("_keep")).alias("_keep"), "_n", F.explode(places).alias("_salt"))

    asked = marked(short).select("doc_id", "_sha", F.when(F.col("_hot"), F.col("_any")).otherwise(0).alias("_salt"))
    return asked.join(placed, ["_sha", "_salt"]).select(
        "doc_id",
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the winning row of every group of equal texts, with the columns of documents.

    Null texts are equal to empty ones. Of repeated rows, and of rows with one doc_id whose texts are
    equal, one stays, the same one in every run; different texts under one doc_id are different documents.
    A row without doc_id cannot be told from another and goes. Columns beyond doc_id and text are carried
    along, whatever their names. The texts are shuffled once more here, and the last step works on that
    partitioning.
    """
    kept = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("__sha")).distinct()
    met = docs.withColumn("__sha", F.sha2(normalised(F.col("text")), 256)).join(kept, ["doc_id", "__sha"], "left_semi")
    return one_row_each(met, "doc_id", "__sha").select(*docs.columns)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
"""
