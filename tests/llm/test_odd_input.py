"""Nulls, ties, repeated rows, long texts and clashing names in operators 2, 5 and 7."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, hamming_topk, mixing


def test_sign_codes_of_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [None] * 64), (4, [float("nan")] * 64), (5, [1.0, -1.0]), (6, [1.0] * 64 + [-3.0] * 64), (7, [0.0] * 63 + [2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r["id"]: r["code"] for r in df.select("id", hamming_topk.sign_code(F.col("v")).alias("code")).collect()}
    assert got == {1: None, 2: None, 3: 0, 4: 0, 5: 1, 6: 0, 7: -(1 << 63)}


def test_top_k_with_clashing_names_and_repeated_rows(spark):
    rows = [(i, c, "x", 1, 2) for i, c in [(1, 0), (1, 0), (2, 1), (3, 3), (None, 0), (4, None), (5, 3)]]
    df = spark.createDataFrame(rows, "id bigint, code bigint, distance string, rank int, shard int")
    got = [tuple(r) for r in hamming_topk.top_k(df, df, 2).orderBy("id", "rank").collect()]
    want = {1: [(2, 1), (3, 2)], 2: [(1, 1), (3, 1)], 3: [(5, 0), (2, 1)], 5: [(3, 0), (2, 1)]}
    assert got == [(i, at + 1, n, d) for i, near in want.items() for at, (n, d) in enumerate(near)]
    assert hamming_topk.top_k(df.limit(0), df.limit(0), 2).count() == 0


def test_chat_of_ties_repeats_and_long_texts(spark):
    long = "w " * 200_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, None, None), (2, 5, "user", "x"), (None, 1, "user", "n")]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, problem int")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    template = chat_format.ChatTemplate()
    assert chat_format.parse(got[1]["formatted"], template) == [("user", "a"), ("user", "b"), ("assistant", long), ("assistant", long)]
    assert chat_format.parse(got[2]["formatted"], template) == [("", ""), ("user", "x")] and got[2]["problem"] is not None
    assert chat_format.parse(got[None]["formatted"], template) == [("user", "n")] and len(got) == 3
    assert chat_format.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [1, 40])
def test_mixing_draws_rows_of_one_id_together(spark, copies):
    rows = [(i % 7, "word " * (i % 5), "en" if i % 2 else None, "a", 1, "t", 0.5) for i in range(28 * copies)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, topic string, probability double")
    made = mixing.mix(df)
    assert made.count() == len(rows)
    apart = made.groupBy("doc_id", "source", "lang", "topic").agg(F.count_distinct("sampled").alias("n")).where("n > 1")
    assert apart.isEmpty()
