"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessella.llm import bpe, chat_format, exact_dedup, hamming_topk, language_id, mixing, pii, prefix_trie, simhash, substring_dedup, token_coder, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_top_k": hamming_topk.op2_exact_top_k,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_bpe_encoding": bpe.op6_bpe_encoding,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_pii": pii.op9_pii,
    "op10_token_ids": token_coder.op10_token_ids,
    "op11_warc": warc.op11_warc,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_exact_top_k": hamming_topk.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_warc": warc.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
