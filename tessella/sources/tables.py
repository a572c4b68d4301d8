"""Reading tables of cases and writing results."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.config import ClusterConfig

#: Text that stands for a missing value.
NULL_TOKENS = ("", "NA", "N/A", "NaN", ".")


def read_cases(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A columnar table; ValueError if it is empty or repeats a column name."""
    if fmt not in ("parquet", "orc", "json"):
        raise ValueError(f"cannot read {fmt}")
    df = getattr(spark.read, fmt)(path)
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("column names are repeated")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def null_tokens(c: Column) -> Column:
    return F.when(F.trim(c).isin(*NULL_TOKENS), None).otherwise(F.trim(c))


def clean(df: DataFrame) -> DataFrame:
    """Names trimmed, blank ones called V1, V2, ...; dates and times as text; columns, then rows, without any
    value dropped."""
    names = [c.strip() or f"V{i + 1}" for i, c in enumerate(df.columns)]
    df = df.toDF(*names)
    timed = (T.DateType, T.TimestampType, T.TimestampNTZType)
    df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, timed) else F.col(f"`{f.name}`") for f in df.schema.fields])
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]]).dropna("all")


def with_clusters(table: DataFrame, key: str, memberships: DataFrame, ks: list[int]) -> DataFrame:
    """``table`` with a column Cluster_k<k> for each k of ``memberships(k, id, cluster)``; null for cases left out."""
    wide = memberships.groupBy("id").pivot("k", ks).agg(F.first("cluster"))
    wide = wide.select(F.col("id").alias("_id"), *[F.col(str(k)).alias(f"Cluster_k{k}") for k in ks])
    return table.join(wide, F.col(key) == F.col("_id"), "left").drop("_id")


def write_results(tables: dict[str, DataFrame], config: ClusterConfig, path: str, fmt: str = "csv") -> None:
    """Each table in a folder of its own (nulls as empty text in CSV), and the settings as JSON."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if fmt == "csv":
            flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns]
            df.select(*flat).write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    settings = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(config).items()}
    settings["levels"] = [f"{k}={v}" for k, v in config.levels.items()] or [""]
    fields = [F.array(*map(F.lit, v)).alias(k) if isinstance(v, list) and v else F.lit(None if isinstance(v, list) else v).alias(k) for k, v in settings.items()]
    spark.range(1).select(*fields).write.mode("overwrite").json(f"{path}/settings")


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tables of the same kind, one under the other; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read_cases(spark, p) for p in paths))
