"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import materialize  # noqa: F401  (the operators take it from here)

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Texts that go to a Python worker at a time; they may be long.
TEXTS_PER_BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows for this session: what a Python worker holds follows from their number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character is left alone."""
    return F.translate(text, A_Z, A_Z.lower())


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of ``key``: the same in every engine and partitioning."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint") / F.lit(float(2**60))


def one_row_each(docs: DataFrame, *keys: str) -> DataFrame:
    """One row of ``docs`` for each value of the keys: that of the smallest hash of all columns, so that a task
    run again chooses alike."""
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    return docs.groupBy(*keys).agg(row).select("_row.*")
