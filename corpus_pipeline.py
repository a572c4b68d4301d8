"""A corpus pipeline of five operators: language ID, exact dedup, SimHash near-dedup, mixing, BPE.

Each stage reads what the one before it kept, written as Parquet in the folder the executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.bpe import stage_bpe
from tessella.llm.common import documents, materialize
from tessella.llm.exact_dedup import stage_exact_dedup
from tessella.llm.language_id import stage_language_id
from tessella.llm.mixing import stage_mixing
from tessella.llm.near_copies import stage_near_dedup

STAGES = [
    ("language_id", stage_language_id),
    ("exact_dedup", stage_exact_dedup),
    ("simhash_near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("bpe_encoding", stage_bpe),
]

#: Language models and byte-pair encoding have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
