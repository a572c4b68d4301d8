"""Ranks and order statistics by key, when a key may hold any number of rows.

Ranks come from one sort by ranges of (key, order): a range is a task, so a large key is spread over many, and ranks
continue from range to range by the counts of those before. Order statistics need no sort: approximate percentiles
with a known error bracket the value, and only the few distinct values inside the bracket are counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

#: Accuracy of the bracket: about six in ACCURACY of a key's rows lie inside.
ACCURACY = 10_000


def ranked(rows: DataFrame, keys: tuple[str, ...], order: list[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` with ``rank`` from 1 within the keys by ``order``, which should end in something unique. Written: the bounds of
    the ranges come from a sample, and a second pass could draw others."""
    named = [(f"_o{i}", F.col(c) if isinstance(c, str) else c) for i, c in enumerate(order)]
    dealt = rows.withColumns(dict(named))
    by = [*keys, *[c for c, _ in named]]
    dealt = materialize(dealt.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*[c for c, _ in named]))
    # A key has a count for each range it reaches into: a table of ranges plus keys.
    counts = dealt.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_p") if keys else Window.orderBy("_p")
    starts = counts.select(*keys, "_p", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    met = dealt.withColumn("_in", inside).join(starts if keys else F.broadcast(starts), [*keys, "_p"])
    return met.withColumn(name, F.col("_before") + F.col("_in")).select(*rows.columns, name)


def order_statistics(values: DataFrame, keys: tuple[str, ...], share: float, ranks: dict[str, Callable[[Column], Column]], value: str = "v") -> DataFrame:
    """(keys, n, and for each name in ``ranks``: the value at that rank, from 0, and ``before_<name>``, the number of smaller ones).

    ``ranks`` are functions of the number n of a key's values, near ``share`` of n; nulls are left out. A pass
    brackets the value of every key, a second one counts what is below the bracket and the distinct values inside.
    """
    rows = values.select(*keys, F.col(value).alias("v")).where("v is not null")
    low, high = max(0.0, share - 3 / ACCURACY), min(1.0, share + 3 / ACCURACY)
    aggs = [F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [low, high], ACCURACY).alias("_b"), F.min("v").alias("_min"), F.max("v").alias("_max")]
    bracket = materialize(rows.groupBy(*keys).agg(*aggs)) if keys else materialize(rows.agg(*aggs))
    # Percentiles are found among doubles, which round large whole numbers; those of share 0 or 1 need not be the end itself.
    whole = dict(rows.dtypes)["v"] in ("bigint", "int", "smallint", "tinyint")
    near = lambda c, sign: c + sign * (F.floor(F.abs(c) / float(2**51)) + 1) if whole else c
    ends = bracket.select(*keys, "n", (F.col("_min") if low == 0 else near(F.col("_b")[0], -1)).alias("_lo"), (F.col("_max") if high == 1 else near(F.col("_b")[1], 1)).alias("_hi"))
    met = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    # Values below the bracket are one row, those inside one row each, with their counts.
    place = F.when(F.col("v") >= F.col("_lo"), F.col("v"))
    counts = met.where(F.col("v") <= F.col("_hi")).groupBy(*keys, "n", place.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("_upto", F.sum("c").over(upto)).where("v is not null")
    picks = []
    for name, rank in ranks.items():
        hit = F.when(F.col("_upto") > rank(F.col("n")), F.struct("v", (F.col("_upto") - F.col("c")).alias("before")))
        picks += [F.min(hit)["v"].alias(name), F.min(hit)["before"].alias(f"before_{name}")]
    return running.groupBy(*keys, "n").agg(*picks) if keys else running.groupBy("n").agg(*picks)


def medians(values: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """(keys, median): exact, the mean of the two middle values of an even number."""
    middle = {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)}
    return order_statistics(values, keys, 0.5, middle, value).select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def smallest(rows: DataFrame, keys: tuple[str, ...], score: str, size: int, total: int, tie: str = "id") -> DataFrame:
    """The ``size`` rows of smallest ``score`` of every key, of equal scores those of smallest ``tie``. ``total`` is about the number
    of rows of a key. Only rows at the very cut are ranked."""
    if size <= 0:
        return rows.limit(0)
    last = {"_cut": lambda n: F.least(F.lit(size), n) - 1}
    cut = order_statistics(rows, keys, min(1.0, max(0.0, (size - 1) / max(total - 1, 1))), last, score).select(*keys, "_cut", F.col("before__cut").alias("_less"))
    met = rows.join(cut, list(keys)) if keys else rows.crossJoin(F.broadcast(cut))
    below = met.where(F.col(score) < F.col("_cut"))
    at = met.where(F.col(score) == F.col("_cut")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, score).orderBy(tie)))
    return below.select(*rows.columns).unionByName(at.where(F.col("_r") <= size - F.col("_less")).select(*rows.columns))
