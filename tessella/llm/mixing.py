"""Mixing sources to target weights by iterative proportional fitting, DataFrame functions only.

Tokens are counted per cell (source, language, topic). Raking scales the cells so that their sums
over each dimension meet that dimension's targets, one dimension after another, round by round; the
ratio of a cell's raked weight to its tokens is the weight of its documents. Documents are then drawn
with probability proportional to it, scaled so that the most wanted cell is taken whole: expected
token shares equal the targets, and nobody is taken twice. The draw is a hash of doc_id, so it does
not depend on partitioning and repeats under retries.

Only the cell table is raked: it has one row for each combination that occurs, whatever the number of
documents. Sums over cells are windows of that table, and each round is written to the shared folder to
cut lineage.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import documents, hash_uniform, materialize

DIMENSIONS = ("source", "lang", "topic")
MISSING = "(null)"
TOKEN = "[^ \\t\\n\\r]+"
#: First rule that matches names the topic; patterns mean the same to Java and RE2.
TOPICS: tuple[tuple[str, str], ...] = (
    ("licence", "[Ll]icen[sc]e"),
    ("contact", "[A-Za-z0-9]@[A-Za-z0-9]"),
    ("shouting", "!!"),
    ("markup", "###|%%%|&&&"),
)
OTHER_TOPIC = "prose"


@dataclass(frozen=True)
class MixParams:
    """Targets are shares per value of a dimension; a dimension without targets is tempered: its
    shares become (token share) ** temperature, normalised. Values that occur but have no target get
    none. ``rounds`` is the number of raking rounds over all dimensions."""

    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    temperature: float = 0.5
    rounds: int = 6
    seed: str = "mix"


def topic_of(text: Column) -> Column:
    rules = reduce(lambda made, rule: made.when(text.rlike(rule[1]), rule[0]), TOPICS[1:], F.when(text.rlike(TOPICS[0][1]), TOPICS[0][0]))
    return rules.otherwise(OTHER_TOPIC)


def _dimensions(text: Column) -> dict[str, Column]:
    return {"source": F.coalesce("source", F.lit(MISSING)), "lang": F.coalesce("lang", F.lit(MISSING)), "topic": topic_of(text)}


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the three dimensions and the number of tokens of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(TOKEN)).cast("bigint").alias("n_tokens")
    return docs.select("doc_id", *[c.alias(d) for d, c in _dimensions(text).items()], tokens)


def target_table(cells: DataFrame, dimension: str, params: MixParams) -> DataFrame:
    """(value, share): what each value of a dimension is to get of all tokens."""
    given = params.targets.get(dimension)
    if given is None:
        sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        raw = sums.select("value", F.pow(F.col("t").cast("double"), F.lit(params.temperature)).alias("r"))
    else:
        pairs = F.array(*[F.struct(F.lit(k).alias("value"), F.lit(float(v)).alias("r")) for k, v in sorted(given.items())])
        wanted = cells.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*")
        raw = wanted.join(cells.where("tokens > 0").select(F.col(dimension).alias("value")).distinct(), "value")
    return raw.crossJoin(raw.agg(F.sum("r").alias("all"))).select("value", (F.col("r") / F.col("all")).alias("share"))


def rake(cells: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``share``, the raked share of all tokens.

    Cells without tokens get share 0. No cells give no rows. Combinations that do not occur stay
    empty; if the targets can't all be met with the rest, the dimension raked last is met exactly.
    """
    cells = materialize(cells)
    raked = cells.withColumn("share", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        wanted = target_table(cells, d, params).select(F.col("value").alias(d), F.col("share").alias(f"_{d}"))
        raked = raked.join(wanted, d, "left")
    raked = materialize(raked)
    for _ in range(params.rounds):
        for d in DIMENSIONS:
            now = F.sum("share").over(Window.partitionBy(d))
            raked = raked.withColumn("share", F.when(now > 0, F.col("share") * F.coalesce(f"_{d}", F.lit(0.0)) / now).otherwise(0.0))
        raked = materialize(raked)
    return raked.select(*DIMENSIONS, "tokens", "share")


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source, ...)``: doc_id, source, lang, topic,
    n_tokens, probability (of being drawn) and sampled.

    Null source or lang is a value of its own, ``(null)``; null and empty texts have no tokens and
    are drawn like the other documents of their cell (never from a cell without tokens). Rows with
    one doc_id are drawn together. An empty table gives an empty result.
    """
    rows = described(docs)
    placed = rows.join(odds_table(rows, params), list(DIMENSIONS), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return placed.select("doc_id", *DIMENSIONS, "n_tokens", "probability", drawn("doc_id", "probability", params).alias("sampled"))


def odds_table(rows: DataFrame, params: MixParams) -> DataFrame:
    """(source, lang, topic, probability) from ``rows(source, lang, topic, n_tokens)``."""
    raked = rake(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), params).where("tokens > 0").withColumn("w", F.col("share") / F.col("tokens"))
    top = raked.agg(F.max("w").alias("most"))
    return raked.crossJoin(top).select(*DIMENSIONS, F.round(F.col("w") / F.col("most"), 9).alias("probability"))


def drawn(doc_id: str, probability: str, params: MixParams) -> Column:
    return hash_uniform(F.concat(F.lit(f"{params.seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(MISSING)))) < F.col(probability)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, with the columns of documents; only the table of cells meets them.

    Null source or lang is a value of its own; null and empty texts have no tokens and are drawn like the other
    documents of their cell; rows with one doc_id are drawn together; texts are counted whole. Columns beyond
    those of documents are carried along. An empty table gives an empty result.
    """
    params = MixParams()
    odds = odds_table(described(docs), params).select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("probability").alias("__probability"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({f"__{d}": c for d, c in _dimensions(text).items()})
    return keyed.join(odds, [f"__{d}" for d in DIMENSIONS]).where(drawn("doc_id", "__probability", params)).select(*docs.columns)


def oracle(params: MixParams = MixParams()) -> str:
    """The same in SQL, rounds unrolled."""
    topic = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in TOPICS)
    steps, last = [], "r0"
    for i in range(params.rounds * 3):
        d = DIMENSIONS[i % 3]
        steps.append(f"r{i + 1} AS (SELECT source, lang, topic, tokens, c.w * t.share / sum(c.w) OVER (PARTITION BY c.{d}) AS w FROM {last} c JOIN t_{d} t ON t.value = c.{d})")
        last = f"r{i + 1}"
    targets = ",\n".join(
        f"t_{d} AS (SELECT {d} AS value, sum(tokens) ** {params.temperature} / sum(sum(tokens) ** {params.temperature}) OVER () AS share FROM r0 GROUP BY {d} HAVING sum(tokens) > 0)" for d in DIMENSIONS
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, source, lang, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic,
             len(regexp_extract_all(t, '{TOKEN}')) AS n_tokens FROM d),
r0 AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS w FROM e GROUP BY ALL HAVING sum(n_tokens) > 0),
{targets},
{", ".join(steps)},
p AS (SELECT source, lang, topic, round(w / tokens / max(w / tokens) OVER (), 9) AS probability FROM {last})
SELECT doc_id, topic, n_tokens, round(coalesce(probability, 0), 6) AS probability,
       ('0x' || substr(md5('{params.seed}|' || doc_id::VARCHAR), 1, 15))::BIGINT / 1152921504606846976.0 < coalesce(probability, 0) AS sampled
FROM e LEFT JOIN p USING (source, lang, topic)
"""


ORACLE = oracle()
