"""The pipeline against a plain Python run over the same decisions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, language_id, mixing
from tests.llm.test_near_copies import alike, groups
from tests.llm.test_operators import SF, lower


@pytest.fixture(scope="module")
def stages(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", df)]
    for name, f in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialize(f(spark, df, SF))
        out.append((name, df))
    return out


def test_stages_keep_columns_and_clean_documents(stages):
    columns = stages[0][1].columns
    for name, df in stages[1:-1]:
        assert df.columns == columns, name
    counts = [df.count() for _, df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert counts[1] >= 0.97 * counts[0]  # hardly any document is rejected for its language


def test_stages_by_brute_force(stages):
    tables = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for _, df in stages[:-1]]
    last = {}
    for i, t in tables[1].items():
        last[lower(t)] = max(i, last.get(lower(t), -1))
    assert set(tables[2]) == set(last.values())
    roots = groups(alike(tables[2]), tables[2])
    assert set(tables[3]) == set(roots.values())
    assert set(tables[4]) <= set(tables[3])
    encode = bpe.encoder(bpe.default_vocabulary()).encode
    rows = stages[-1][1].collect()
    assert {r["doc_id"] for r in rows} == set(tables[4])
    for r in random.Random(1).sample(rows, min(20, len(rows))):
        assert r["ids"] == encode(tables[4][r["doc_id"]])


def test_run_equals_its_stages(spark, stages):
    got = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()}
    assert got == {(r["doc_id"], r["ids_sha256"]) for r in stages[-1][1].select("doc_id", "ids_sha256").collect()}


def test_stages_take_odd_tables(spark):
    rows = [(1, "The house is on the hill and it is big", "en", "a", 3), (1, "The house is on the hill and it is big", "en", "a", 3), (None, None, None, None, None), (3, "", None, "b", 0), (4, "xyz " * 5000, "en", None, 1)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, cluster string")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, df, SF).count() <= len(rows), name
        assert f(spark, df.limit(0), SF).count() == 0, name
    assert language_id.UNDETERMINED not in {r[0] for r in language_id.identify(df).where(F.col("doc_id") == 1).select("lang_pred").collect()}
    assert mixing.mix(df).count() == len(rows)
