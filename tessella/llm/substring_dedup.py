"""Substring dedup by hashing units of text: lines, and the sentences within them.

Each text is cut into units with their offsets. A unit is normalised (case folded, anything but
letters and digits dropped, so that spacing and punctuation do not matter) and hashed to 128 bits.
Digests are grouped over all documents; the occurrence of lowest rank (doc_id, then position) stays
and every other one is removed. Units under ``min_words`` words are never removed: short phrases recur in
clean text. Working on the sentences of a line finds a passage that stands amid other text, not only
one on lines of its own.

Only digests and offsets are shuffled for the grouping. The minimum per digest is pre-aggregated on
the map side, so a line that a third of all documents share costs a row per map task. The decision
goes back to the units on (digest, salt): a frequent digest, one that several salts hold, is dealt
over all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, materialize

MIN_WORDS = 7
SALTS = 32
#: A unit ends at a line break, or at . ! or ? before white space.
_END = re.compile(r"[.!?]+(?=\s)")
_JUNK = re.compile(r"[\W_]+")


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """start, end (code points) and digest of each unit long enough to be compared."""
    line = 0
    while line <= len(text):
        stop = text.find("\n", line)
        stop = len(text) if stop < 0 else stop
        start = line
        for m in _END.finditer(text, line, stop):
            yield from _unit(text, start, m.end(), min_words)
            start = m.end()
        yield from _unit(text, start, stop, min_words)
        line = stop + 1


def _unit(text: str, start: int, end: int, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    words = _JUNK.sub(" ", text[start:end].casefold()).split()
    if len(words) >= min_words:
        yield start, end, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans, which are in order and apart."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _placed(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                twin = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                rows += [(doc, twin, a, b, digest) for a, b, digest in units(text or "", min_words)]
                if len(rows) > 100_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "twin", "start", "end", "digest"])
    return out.astype({"doc_id": "Int64"})


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, twin, start, end of every unit to remove from ``docs(doc_id, text, ...)``.

    ``twin`` tells apart rows that share a doc_id but not the text.
    """
    schema = "doc_id bigint, twin bigint, start int, end int, digest binary"
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(_placed(min_words), schema)
    found = materialize(found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("byte")))
    rank = F.struct("doc_id", "twin", "start")
    salted = found.groupBy("digest", "salt").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    first = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    dealt = materialize(first.select("digest", "first", F.explode("salts").alias("salt")))
    again = found.join(dealt, ["digest", "salt"]).where(~F.struct("doc_id", "twin", "start").eqNullSafe(F.col("first")))
    return again.select("doc_id", "twin", "start", "end")


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, removed (spans of the original text, in
    code points, by start), kept_text.

    A unit stays where its rank is lowest (doc_id, null first, then text and position) and is removed
    elsewhere, also later in the same text. Null and empty texts have no unit; kept_text is then
    empty. Repeated rows (same doc_id and text) rank alike, so each of them keeps or loses the same
    spans. An empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_units(docs, min_words).groupBy("doc_id", "twin").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))

    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], dtype="int64")

    def rest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, removed in batches:
            yield pd.Series([t if r is None else cut(t, [(s["start"], s["end"]) for s in r]) for t, r in zip(texts, removed)])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("twin", F.pandas_udf(key, "bigint")("text"))
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("twin").alias("_t"), "removed")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("twin") == F.col("_t")), "left")
    return joined.select("doc_id", F.coalesce("removed", F.expr("array()")).alias("removed"), F.pandas_udf(rest, "string")("text", "removed").alias("kept_text"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_units(documents(spark, sf_dir))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), spans.alias("removed_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
