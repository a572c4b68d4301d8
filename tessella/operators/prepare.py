"""Coding and scaling variables; the prepared case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.config import ClusterConfig
from tessella.functions.distance import BINARY, COUNT, check_domain, whiten
from tessella.operators import impute, profile
from tessella.operators.order import medians
from tessella.session import materialize

MAD_FACTOR = 1.4826


@dataclass(frozen=True)
class Prepared:
    """``cases``: id, the coded variables, x (array). ``ranges`` are those Gower distance needs."""

    cases: DataFrame
    variables: list[str]
    weights: tuple[float, ...]
    config: ClusterConfig
    ranges: list[float] | None = None
    donors: DataFrame | None = None
    audit: DataFrame | None = None

    @property
    def euclidean(self) -> bool:
        return self.config.distance in ("euclidean", "sqeuclidean")


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def as_continuous(df: DataFrame, v: str) -> DataFrame:
    """Text to numbers, logical to 0/1, non-finite to null; ValueError for text that is no number."""
    text = isinstance(df.schema[v].dataType, T.StringType)
    number = F.col(v).try_cast("double") if text else F.col(v).cast("double")
    if text and not df.where(F.col(v).isNotNull() & number.isNull()).isEmpty():
        raise ValueError(f"{v} holds text that is not a number")
    return df.withColumn(v, finite(number))


def as_binary(df: DataFrame, v: str) -> DataFrame:
    """0/1 in numbers or text stay; of two other values the second in order becomes 1."""
    c = F.trim(F.col(v).cast("string"))
    values = [r[0] for r in df.select(c.alias("v")).where("v is not null").distinct().orderBy("v").limit(3).collect()]
    if len(values) > 2:
        raise ValueError(f"{v} has more than two values")
    if all(_number(x) in (0.0, 1.0) for x in values):
        return df.withColumn(v, c.try_cast("double"))
    if isinstance(df.schema[v].dataType, T.NumericType):
        return df.withColumn(v, F.col(v).cast("double"))
    return df.withColumn(v, F.when(c == values[-1], 1.0).when(c.isNotNull(), 0.0))


def _number(x: str) -> float | None:
    try:
        return float(x)
    except ValueError:
        return {"true": 1.0, "false": 0.0}.get(x.lower())


def as_ordinal(df: DataFrame, v: str, order: list[str] | None = None, rank: bool = False) -> DataFrame:
    """Numeric codes stay as they are, or become ranks; text becomes its rank in ``order``."""
    if order is not None:
        ranks = F.create_map(*[F.lit(x) for i, level in enumerate(order) for x in (level, float(i + 1))])
        return df.withColumn(v, F.try_element_at(ranks, F.col(v).cast("string")))
    df = as_continuous(df, v)
    if not rank:
        return df
    levels = df.select(v).where(F.col(v).isNotNull()).distinct()
    coded = levels.join(levels.select(F.col(v).alias("_lower")), F.col("_lower") <= F.col(v)).groupBy(v).agg(F.count(F.lit(1)).cast("double").alias("_rank"))
    return df.join(coded, v, "left").withColumn(v, F.col("_rank")).drop("_rank")


def encode(df: DataFrame, config: ClusterConfig) -> DataFrame:
    levels = dict(config.levels)
    if not all(v in levels for v in config.variables):
        levels |= {r["Variable"]: r["Level"] for r in profile.auto_levels(df, [v for v in config.variables if v not in levels]).collect()}
    for v in config.variables:
        if levels[v] == "binary":
            df = as_binary(df, v)
        elif levels[v] == "ordinal":
            df = as_ordinal(df, v, rank=config.distance == "gower")
        elif levels[v] == "continuous":
            df = as_continuous(df, v)
        else:
            raise ValueError(f"{v} is text and cannot be analysed")
    return df


def scale_model(df: DataFrame, variables: list[str], kind: str, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Variable, Center, Scale (per group): mean and sample SD, minimum and range, median and MAD, or 0
    and 1. Nulls are left out."""
    long = df.select(*group_cols, F.explode(F.array(*[F.struct(F.lit(v).alias("Variable"), F.col(v).cast("double").alias("v")) for v in variables])).alias("r")).select(*group_cols, "r.*").where("v is not null")
    keys = [*group_cols, "Variable"]
    if kind == "z":
        return long.groupBy(*keys).agg(F.avg("v").alias("Center"), F.stddev_samp("v").alias("Scale"))
    if kind == "range":
        return long.groupBy(*keys).agg(F.min("v").alias("Center"), (F.max("v") - F.min("v")).alias("Scale"))
    if kind == "none":
        return long.groupBy(*keys).agg(F.lit(0.0).alias("Center"), F.lit(1.0).alias("Scale"))
    if kind == "robust":
        centre = materialize(medians(long, tuple(keys)).withColumnRenamed("median", "Center"))
        gaps = long.join(F.broadcast(centre) if not group_cols else centre, keys).select(*keys, F.abs(F.col("v") - F.col("Center")).alias("v"))
        return centre.join(medians(gaps, tuple(keys)), keys).select(*keys, "Center", (MAD_FACTOR * F.col("median")).alias("Scale"))
    raise ValueError(f"unknown scaling {kind!r}")


def scaled(df: DataFrame, variables: list[str], kind: str) -> DataFrame:
    """``df`` with its variables scaled; ValueError for a constant variable."""
    model = {r["Variable"]: (r["Center"], r["Scale"]) for r in scale_model(df, variables, kind).collect()}
    spread = profile.describe(df, variables).where("Maximum = Minimum").select("Variable").collect()
    flat = [r[0] for r in spread] or [v for v in variables if v not in model or not model[v][1]]
    if flat:
        raise ValueError(f"cannot scale {', '.join(flat)}: no variation" + (" about the median" if kind == "robust" and not spread else ""))
    return df.withColumns({v: (F.col(v) - model[v][0]) / model[v][1] for v in variables})


def assemble(df: DataFrame, variables: list[str], weights: tuple[float, ...] | None = None, out: str = "x") -> DataFrame:
    """Adds the prepared case as an array, each variable times the root of its weight."""
    weights = weights or (1.0,) * len(variables)
    return df.withColumn(out, F.array(*[F.col(v) if w == 1 else F.col(v) * float(w**0.5) for v, w in zip(variables, weights)]))


def prepare(df: DataFrame, config: ClusterConfig) -> Prepared:
    """Code, fill in, filter, scale and assemble the cases of an analysis."""
    variables, weights = list(config.variables), config.weight()
    profile.check_key(df, config.id)
    coded = encode(df.select(F.col(config.id).alias("id"), *variables), config)
    filled, donors = coded, None
    if config.missing == "mean":
        filled = impute.mean_impute(coded, variables, config.max_missing)
    elif config.missing == "neighbor":
        filled, donors = impute.neighbour_impute(coded, scaled(coded, variables, config.scaling), variables, weights, config.donor_threshold, config.max_missing)
    available = config.missing == "available"
    kept = profile.keep_cases(filled, variables, available)
    profile.require_cases(kept)
    audit = profile.case_audit(coded, filled, "id", variables, available)
    ranges = None
    if config.distance == "gower":
        found = {r["Variable"]: r["Scale"] for r in scale_model(kept, variables, "range").collect()}
        ranges = [found[v] for v in variables]
        cases = assemble(kept, variables)
    elif config.distance in (*BINARY, *COUNT):
        check_domain(kept, variables, config.distance)
        cases = assemble(kept, variables)
    else:
        z = scaled(kept, variables, config.scaling)
        z = whiten(z, variables) if config.distance == "mahalanobis" else assemble(z, variables, weights)
        cases = kept.join(z.select("id", "x"), "id")
    return Prepared(cases, variables, weights, config, ranges, donors, audit)
