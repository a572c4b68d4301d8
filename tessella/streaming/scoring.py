"""Scoring streams: new cases are classified by the centres of a finished solution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.kmeans import nearest


def classify_stream(cases: DataFrame, centres: DataFrame) -> DataFrame:
    """A stream ``cases(id, x)`` with cluster and d2. Stateless: each case meets the k centres only, so any
    number of files or late rows is scored as they come."""
    return nearest(cases, centres)


def scaled_stream(rows: DataFrame, key: str, model: dict[str, tuple[float, float]]) -> DataFrame:
    """Raw rows of a stream as prepared cases, with the centre and scale the solution was made with."""
    return rows.select(F.col(key).alias("id"), F.array(*[(F.col(v) - c) / s for v, (c, s) in model.items()]).alias("x"))


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores as Parquet, each file of input once; processes what is there and stops."""
    return scored.select("id", "cluster", "d2").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
