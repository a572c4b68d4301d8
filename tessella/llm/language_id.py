"""Language ID by prediction by partial matching (PPM).

Each language has a variable-order byte context tree with counts of the bytes that follow each
context. The code length of a byte is that of PPM with escape method C and frozen statistics: in the
longest context the language knows, a byte seen c times out of t costs -log2(c / (t + d)), d being
the number of different bytes seen there; any other byte costs an escape, -log2(d / (t + d)), plus
its cost in the next shorter context, and below the empty context all 256 bytes are equally likely.
The language with the shortest code for the whole text wins.

Fitting counts n-grams of a bounded sample of labelled rows on Spark. The trees of all languages are
stored as one: a node for each kept context, and for each node, byte and language the code length.
The model is limited by ``max_nodes`` and the number of languages, so it is small enough to ship to
every task. Scoring walks all positions of a batch of texts at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, hash_uniform, text_batches

UNDETERMINED = "und"
LETTER = r"\p{L}"
#: Bytes of evidence at which the score stops sharpening; keeps scores of long texts comparable.
EVIDENCE = 64
#: Column that the pipeline's stage adds and drops again.
GUESS = "__language_guess"
#: Bytes scored at a time.
CHUNK = 1 << 18


@dataclass(frozen=True)
class PpmParams:
    """docs_per_language bounds the expected number of sampled rows per language; the rows with the
    smallest hash of doc_id are taken, whole. The ``max_languages`` most frequent labels are learned. Contexts longer than ``order`` bytes, seen less than
    ``min_count`` times or beyond the ``max_nodes`` most frequent are not kept."""

    docs_per_language: int = 400
    order: int = 4
    min_count: int = 4
    max_nodes: int = 8000
    max_languages: int = 256


@dataclass(frozen=True)
class PpmModel:
    languages: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol, 0 for the boundary between texts
    child: np.ndarray  # node * n_symbols + symbol before the context -> longer context, or -1
    bits: np.ndarray  # node * n_symbols + symbol -> code length for each language
    order: int

    @property
    def n_symbols(self) -> int:
        return int(self.symbol.max()) + 1


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def sample_rows(docs: DataFrame, params: PpmParams) -> DataFrame:
    """About ``docs_per_language`` labelled rows of each language, chosen by hash of doc_id.

    Only the counts of the languages come to the driver, ``max_languages`` at most; the rows are filtered
    where they are, without a shuffle.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(params.max_languages).collect()
    if not sizes:
        return labelled.limit(0).select("lang", "text")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, params.docs_per_language / r["n"]))])
    drawn = hash_uniform(F.concat(F.lit("ppm|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return labelled.where(drawn < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "text")


def _ngrams(order: int):
    """Counts the byte n-grams of up to order + 1 bytes, packed as one integer."""

    def counted(lang: str, texts: list[bytes]) -> Iterator[pd.DataFrame]:
        buf = np.frombuffer(b"\x00".join(texts), np.uint8).astype(np.int64)
        gram, whole = buf, buf > 0
        for k in range(order + 1):
            if k:  # one byte longer to the left; index j stands for the gram that ends at j + k
                gram, whole = gram[1:] + (buf[:-k] << (8 * k)), whole[1:] & (buf[:-k] > 0)
            found, n = np.unique(gram[whole], return_counts=True)
            yield pd.DataFrame({"lang": lang, "size": np.int32(k + 1), "gram": found, "n": n})
            if len(gram) < 2:
                return

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                held: list[bytes] = []
                for t in texts:
                    held.append(t.encode("utf-8", "surrogatepass").replace(b"\x00", b" "))
                    if sum(map(len, held)) >= 4 * CHUNK:
                        yield from counted(lang, held)
                        held = []
                if held:
                    yield from counted(lang, held)

    return count


def fit(training: DataFrame, params: PpmParams = PpmParams()) -> PpmModel | None:
    """Model of ``training(doc_id, text, lang)``; None if no row has both a language and a text."""
    grams = sample_rows(training, params).mapInPandas(_ngrams(params.order), "lang string, size int, gram bigint, n bigint")
    counted = grams.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    # Bounded: the most frequent n-grams only, the same number whatever the corpus holds.
    kept = counted.where((F.col("size") == 1) | (F.col("n") >= params.min_count))
    top = kept.orderBy(F.col("size") > 1, F.desc("n"), "lang", "gram").limit(params.max_nodes * 40).toPandas()
    return build(top, params) if len(top) else None


def build(grams: pd.DataFrame, params: PpmParams) -> PpmModel:
    """grams: lang, size, gram, n. A context's followers are the grams that extend it by a byte."""
    languages = tuple(sorted(grams["lang"].unique()))
    code = grams["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    size, gram, n = (grams[c].to_numpy(np.int64) for c in ("size", "gram", "n"))
    seen = np.unique(gram[size == 1])
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    symbol[symbol == 0] = len(seen) + 1  # all other bytes are alike: never seen
    symbol[0] = 0
    width = len(seen) + 2

    totals = pd.DataFrame({"size": size - 1, "context": gram // 256, "n": n}).groupby(["size", "context"])["n"].sum()
    totals = totals[totals.index.get_level_values(0) > 0].sort_values(ascending=False, kind="stable")
    wanted = {(0, 0)}
    for key in totals.index[: params.max_nodes]:
        wanted.add((int(key[0]), int(key[1])))
    # A node needs the shorter contexts (its suffixes) as parents.
    names = [k for k in sorted(wanted) if k[0] < 2 or (k[0] - 1, k[1] % 256 ** (k[0] - 1)) in wanted]
    kept = set()
    for k in names:
        if k[0] < 2 or (k[0] - 1, k[1] % 256 ** (k[0] - 1)) in kept:
            kept.add(k)
    names = sorted(kept)
    node = {k: i for i, k in enumerate(names)}

    counts = np.zeros((len(names), width, len(languages)), np.float32)
    for s, g, c, lang in zip(size.tolist(), gram.tolist(), n.tolist(), code.tolist()):
        at = node.get((s - 1, g // 256))
        if at is not None:
            counts[at, symbol[g % 256], lang] += c
    bits = np.zeros_like(counts)
    child = np.full(len(names) * width, -1, np.int32)
    below = np.full((width, len(languages)), 8.0, np.float32)
    for i, (s, g) in enumerate(names):  # shorter contexts first
        if s:
            parent = node[(s - 1, g % 256 ** (s - 1))]
            child[parent * width + symbol[g >> (8 * (s - 1))]] = i
            below = bits[parent]
        here = counts[i]
        total, different = here.sum(0), (here > 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = -np.log2(here / (total + different))
            escape = -np.log2(different / (total + different))
        bits[i] = np.where(total > 0, np.where(here > 0, hit, escape + below), below)
    bits[:, 0, :] = 0  # the boundary is not coded
    return PpmModel(languages, symbol, child, bits.reshape(-1, len(languages)), params.order)


def code_lengths(model: PpmModel, texts: list[bytes]) -> np.ndarray:
    """Bits for each text and language."""
    out = np.zeros((len(texts), len(model.languages)))
    batch: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        batch.append(i)
        held += len(t)
        if held >= CHUNK or i == len(texts) - 1:
            _score(model, texts, batch, out)
            batch, held = [], 0
    return out


def _score(model: PpmModel, texts: list[bytes], batch: list[int], out: np.ndarray) -> None:
    width = model.n_symbols
    data = np.frombuffer(b"\x00".join(texts[i] for i in batch) + b"\x00", np.uint8)
    starts = np.cumsum([0, *(len(texts[i]) + 1 for i in batch)])[:-1]
    sums = np.zeros((len(batch), len(model.languages)))
    for a in range(0, len(data), CHUNK):  # a text longer than a chunk is scored piece by piece
        b, lead = min(a + CHUNK, len(data)), min(a, model.order)
        s = model.symbol[data[a - lead : b]]
        at = np.zeros(len(s), np.int32)
        live = np.ones(len(s), bool)
        for k in range(1, model.order + 1):
            longer = model.child[at[k:] * width + s[:-k]] if len(s) > k else at[:0]
            ok = live[k:] & (longer >= 0)
            at[k:] = np.where(ok, longer, at[k:])
            live[k:] = ok
            live[:k] = False
        cost = model.bits[at[lead:] * width + s[lead:]]
        first, last = np.searchsorted(starts, [a, b - 1], side="right") - 1
        cuts = np.maximum(starts[first : last + 1], a) - a
        sums[first : last + 1] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
    out[batch] = sums


def posterior(bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Score of the best language of each text, from at most EVIDENCE bytes' worth of code length."""
    scale = np.minimum(1.0, EVIDENCE / np.maximum(lengths, 1))[:, None]
    gap = (bits - bits.min(1, keepdims=True)) * scale
    return 1.0 / np.exp2(-gap).sum(1)


def guessed(docs: DataFrame, model: PpmModel | None, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of lang_pred and score; no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for texts in batches:
            data = [(t or "").lower().encode("utf-8", "surrogatepass").replace(b"\x00", b" ") for t in texts]
            if known is None:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(data), "score": 0.0})
                continue
            bits = code_lengths(known, data)
            best = np.array(known.languages, dtype=object)[bits.argmin(1)]
            yield pd.DataFrame({"lang_pred": best, "score": posterior(bits, np.array([len(d) for d in data]))})

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    return docs.withColumn(name, guess("text")).withColumn(name, F.when(lettered, F.col(name)).otherwise(nothing))


def predict(docs: DataFrame, model: PpmModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; see ``identify``."""
    made = guessed(docs.select("doc_id", "text"), model, "_guess")
    return made.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "_guess.lang_pred", "_guess.score")


def fit_on(docs: DataFrame, params: PpmParams = PpmParams()) -> PpmModel | None:
    """Model learned from the rows of ``docs`` that are not held out."""
    training = docs.where(~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)))
    return fit(training.select("doc_id", F.lower("text").alias("text"), "lang"), params)


def identify(docs: DataFrame, params: PpmParams = PpmParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs(doc_id, text, lang, ...)``.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out; the others with a language and a text
    may be learned from. lang, source and doc_id never enter a prediction. A text that is null or
    has no letter is ``und`` with score 0, and so is every text if nothing can be learned. Equal
    texts get equal predictions; equal code lengths go to the language first in order. A null doc_id
    counts as not held out but is sampled like any other row. An empty table gives an empty result.
    """
    return predict(docs, fit_on(docs, params))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Drop documents whose language is undetermined or scores below ``min_score``.

    Null and empty texts, and texts without a letter, are undetermined and go; repeated rows are judged alike and
    all stay; texts are scored whole, in pieces if they are long. An empty table gives an empty result.
    Columns beyond doc_id, text and lang are carried along, whatever their names.
    """
    text_batches(spark)
    made = guessed(docs, fit_on(docs), GUESS)
    return made.where((F.col(f"{GUESS}.lang_pred") != UNDETERMINED) & (F.col(f"{GUESS}.score") >= min_score)).select(*docs.columns)


def crc32_mod4(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
