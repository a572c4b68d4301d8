"""Describing a table of cases before it is clustered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct values are listed up to this many.
LISTED = 7


def _long(df: DataFrame, per_variable: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation over all variables, then one row per variable."""
    aggs = [c.alias(f"{i}_{stat}") for i, stats in enumerate(per_variable.values()) for stat, c in stats.items()]
    rows = [
        F.struct(F.lit(v).alias("Variable"), *[F.col(f"{i}_{stat}").alias(stat) for stat in stats])
        for i, (v, stats) in enumerate(per_variable.items())
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_count(variables: list[str]) -> Column:
    return reduce(lambda a, v: a + F.col(v).isNull().cast("int"), variables, F.lit(0))


def _numeric(df: DataFrame, v: str) -> bool:
    return isinstance(df.schema[v].dataType, (T.NumericType, T.BooleanType))


def describe(df: DataFrame, variables: list[str]) -> DataFrame:
    """Variable, N, Missing, Mean, SD, Minimum, Maximum, Cases_recovered (complete cases won by
    dropping the variable: rows in which it alone is missing). Moments are null for text."""
    missing = missing_count(variables)
    stats = {}
    for v in variables:
        c = F.col(v).cast("double") if _numeric(df, v) else F.lit(None).cast("double")
        stats[v] = {
            "N": F.count(v),
            "Missing": F.count_if(F.col(v).isNull()),
            "Mean": F.avg(c),
            "SD": F.stddev_samp(c),
            "Minimum": F.min(c),
            "Maximum": F.max(c),
            "Cases_recovered": F.count_if((missing == 1) & F.col(v).isNull()),
        }
    return _long(df, stats)


def missingness(df: DataFrame, variables: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return _long(df, {v: {"N": n, "Missing": F.count_if(F.col(v).isNull()), "Missing_percent": 100 * F.try_divide(F.count_if(F.col(v).isNull()), n)} for v in variables})


def missing_patterns(df: DataFrame, variables: list[str]) -> DataFrame:
    """Which variables are missing together: label, N, Percent; frequent patterns first."""
    label = F.concat_ws(" | ", *[F.when(F.col(v).isNull(), v) for v in variables])
    counts = df.groupBy(F.when(label == "", "Complete").otherwise(label).alias("Missing_variables")).agg(F.count(F.lit(1)).alias("N"))
    everyone = df.agg(F.count(F.lit(1)).alias("all"))
    return counts.crossJoin(F.broadcast(everyone)).select("Missing_variables", "N", (100 * F.col("N") / F.col("all")).alias("Percent")).orderBy(F.desc("N"), "Missing_variables")


def _distinct_up_to(v: str, limit: int) -> Column:
    """Number of distinct values; above ``limit`` an estimate is enough to know that it is above."""
    return F.count_distinct(F.col(v)) if limit <= 0 else F.when(F.approx_count_distinct(v, 0.02) > 4 * limit, F.lit(4 * limit)).otherwise(F.count_distinct(F.col(v)))


def default_levels(df: DataFrame, variables: list[str]) -> DataFrame:
    """Variable, Level: binary for logical or two values, ordinal for 3 to 7 whole numbers, continuous
    for other numbers, else text."""
    stats = {}
    for v in variables:
        if not _numeric(df, v):
            stats[v] = {"Level": F.when(F.count_distinct(F.col(v)) == 2, "binary").otherwise("text")}
        elif isinstance(df.schema[v].dataType, T.BooleanType):
            stats[v] = {"Level": F.max(F.lit("binary"))}
        else:
            n, c = F.count_distinct(F.col(v)), F.col(v).cast("double")
            whole = F.coalesce(F.bool_and(F.abs(c - F.round(c)) < 1e-9), F.lit(False))
            stats[v] = {"Level": F.when(n == 2, "binary").when((n >= 3) & (n <= LISTED) & whole, "ordinal").otherwise("continuous")}
    return _long(df, stats)


def auto_levels(df: DataFrame, variables: list[str]) -> DataFrame:
    """Level used when none is given: numbers continuous, two values or fewer binary, numbers written
    as text continuous, else text."""
    stats = {}
    for v in variables:
        text = F.col(v).cast("string")
        if _numeric(df, v):
            stats[v] = {"Level": F.max(F.lit("continuous"))}
        else:
            parsed = F.count(text.try_cast("double")) == F.count(text)
            stats[v] = {"Level": F.when(F.count_distinct(text) <= 2, "binary").when(parsed, "continuous").otherwise("text")}
    return _long(df, stats)


def level_summary(df: DataFrame, variables: list[str]) -> DataFrame:
    """Variable, Summary: the value list for up to 7 numbers, the range beyond, the number of categories
    of text."""
    stats = {}
    for v in variables:
        n = F.count_distinct(F.col(v))
        if _numeric(df, v):
            c = F.col(v).cast("double")
            few = F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ", ")
            stats[v] = {"Summary": F.when(n > LISTED, F.concat_ws(" to ", F.min(c).cast("string"), F.max(c).cast("string"))).otherwise(few)}
        else:
            stats[v] = {"Summary": F.concat(n.cast("string"), F.lit(" categories"))}
    return _long(df, stats)


def summarise_levels(df: DataFrame, variables: list[str]) -> DataFrame:
    """As ``level_summary``, but safe for variables of any number of values: values are listed only
    where a first pass has found few."""
    few = df.agg(*[F.approx_count_distinct(v).alias(v) for v in variables]).first()
    narrow = [v for v in variables if few[v] <= 10 * LISTED]
    parts = []
    if narrow:
        parts.append(level_summary(df, narrow))
    wide = [v for v in variables if v not in narrow]
    if wide:
        stats = {}
        for v in wide:
            c = F.col(v).cast("double") if _numeric(df, v) else None
            stats[v] = {"Summary": F.concat_ws(" to ", F.min(c).cast("string"), F.max(c).cast("string")) if c is not None else F.concat(F.count_distinct(F.col(v)).cast("string"), F.lit(" categories"))}
        parts.append(_long(df, stats))
    return reduce(DataFrame.unionByName, parts)


def id_columns(df: DataFrame, pattern: str = r"(?i)^(.*[_. ])?(id|key|code|case)$|key$") -> DataFrame:
    """Variable, Unique (no null, no repeat), Named (the name says identifier)."""
    n = F.count(F.lit(1))
    stats = {v: {"Unique": (F.count_distinct(F.col(v)) == n) & (F.count(v) == n)} for v in df.columns}
    return _long(df, stats).withColumn("Named", F.col("Variable").rlike(pattern))


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """Nulls, Empty, Duplicated: numbers of rows a key must not have."""
    groups = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("Nulls"),
        F.coalesce(F.sum(F.when(F.trim("k") == "", F.col("n"))), F.lit(0)).alias("Empty"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("Duplicated"),
    )


def check_key(df: DataFrame, key: str) -> None:
    row = key_problems(df, key).first()
    if row["Nulls"] or row["Empty"]:
        raise ValueError(f"{key} has missing or empty values")
    if row["Duplicated"]:
        raise ValueError(f"{key} has repeated values")


def unusable_variables(df: DataFrame, variables: list[str]) -> DataFrame:
    """Variable, Reason for those that cannot contribute: no value, constant, text of many categories."""
    stats = {}
    for v in variables:
        n, d = F.count(v), F.count_distinct(F.col(v))
        reason = F.when(n == 0, "no value").when(d == 1, "constant")
        stats[v] = {"Reason": reason if _numeric(df, v) else reason.when((d > 2) & (F.count(F.col(v).cast("string").try_cast("double")) < n), "text with more than two categories")}
    return _long(df, stats).where("Reason is not null")


def usable_cases(df: DataFrame, variables: list[str]) -> DataFrame:
    missing = missing_count(variables)
    return df.agg(F.count(F.lit(1)).alias("Cases"), F.count_if(missing == 0).alias("Complete"), F.count_if(missing < len(variables)).alias("Any_value"))


def keep_cases(df: DataFrame, variables: list[str], available: bool = False) -> DataFrame:
    """Complete cases, or with ``available`` cases with any value."""
    return df.dropna("all" if available else "any", subset=variables)


def require_cases(df: DataFrame, least: int = 3) -> None:
    if df.limit(least).count() < least:
        raise ValueError(f"at least {least} usable cases are needed after the missing-data rule")


def case_audit(before: DataFrame, after: DataFrame, key: str, variables: list[str], available: bool = False) -> DataFrame:
    """Per case: Original_missing, Imputed_cells, Status. ``after`` is ``before`` with cells filled in."""
    old = before.select(key, missing_count(variables).alias("Original_missing"))
    new = after.select(key, missing_count(variables).alias("_left"))
    kept = F.col("_left") < len(variables) if available else F.col("_left") == 0
    return old.join(new, key).select(
        F.col(key).alias("ID"), "Original_missing", (F.col("Original_missing") - F.col("_left")).alias("Imputed_cells"),
        F.when(kept, "Retained").otherwise("Excluded missing data").alias("Status"),
    )


def preview(df: DataFrame, key: str, rows: int = 15, columns: int = 30) -> DataFrame:
    return df.select(*df.columns[:columns]).orderBy(key).limit(rows)


def check_profiles(df: DataFrame, variables: list[str], k: int) -> None:
    """ValueError if there are fewer distinct cases than clusters asked for."""
    if df.select(*variables).distinct().limit(k).count() < k:
        raise ValueError(f"fewer than {k} distinct cases")
