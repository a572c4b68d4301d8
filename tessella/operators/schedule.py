"""Tables about a hierarchy: agglomeration schedule, stopping rule, dendrogram cut, silhouette order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.order import ranked
from tessella.session import indexed, materialize

WARD = ("ward.D2", "ward_relocate")


def stages(merges: DataFrame) -> DataFrame:
    """The table that ``agglomeration`` takes, of a tree's ``merges(a, b, height, n)`` in any order or
    ``merges(stage, a, b, height)`` in theirs; groups are named by their first case, a merged group keeps the name a.

    Without stages, merges are ordered by height at 12 digits; of equal ones the smaller merged group comes
    first, so every group is formed before it is merged. The stage at which b was formed is the last that bears its name.
    """
    if "stage" not in merges.columns:
        key = F.struct(F.format_string("%.11e", "height").cast("double").alias("h"), "n", "a", "b")
        merges = indexed(merges.withColumn("_key", key), "_key").select((F.col("index") + 1).cast("bigint").alias("stage"), "a", "b", "height", F.col("n").cast("bigint").alias("n"))
    sizes = [c for c in ("n",) if c in merges.columns]
    merges = materialize(merges.select("stage", "a", "b", "height", *sizes))
    formed = merges.groupBy(F.col("a").alias("b")).agg(F.max("stage").alias("_b"))
    earlier = F.lag("stage").over(Window.partitionBy("a").orderBy("stage"))
    met = merges.withColumn("_a", earlier).join(formed, "b", "left")
    never = F.lit(0).cast("bigint")
    return met.select("stage", F.coalesce("_a", never).alias("a"), F.coalesce("_b", never).alias("b"), "height", F.col("a").alias("first_a"), F.col("b").alias("first_b"), *sizes)


def agglomeration(merges: DataFrame, method: str) -> DataFrame:
    """The schedule of ``merges(stage, a, b, height, first_a, first_b)``: a and b are the stages at which the merged
    groups were formed, 0 for single cases; first_a and first_b their first cases.

    A hierarchy has one row per case less one; of trees made from pairs that is as many as the square root of the
    pairs allowed, of others as many as there are representatives, so the running sum is over a bounded table.
    """
    merges, order = merges.drop("n"), Window.orderBy("stage")
    n = merges.agg((F.count(F.lit(1)) + 1).alias("n"))
    swap = F.col("first_a") > F.col("first_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    coefficient = F.sum(F.col("height") * F.col("height") / 2).over(order) if method in WARD else F.col("height")
    later = merges.select(F.col("stage").alias("_next"), F.explode(F.array("a", "b")).alias("_formed")).where("_formed > 0")
    made = merges.withColumn("Coefficient", coefficient)
    made = made.withColumn("_before", F.lag("Coefficient").over(order))
    return made.join(later, made["stage"] == later["_formed"], "left").crossJoin(F.broadcast(n)).select(
        F.col("stage").alias("Stage"), pick("first_a", "first_b").alias("Cluster_1"), pick("first_b", "first_a").alias("Cluster_2"), "Coefficient",
        F.when(F.col("_before") > 0, F.col("Coefficient") / F.col("_before") - 1).alias("Relative_increase"), (F.col("n") - F.col("stage")).alias("Clusters_after_stage"),
        pick("a", "b").alias("First_stage_cluster_1"), pick("b", "a").alias("First_stage_cluster_2"), F.coalesce("_next", F.lit(0)).alias("Next_stage"),
    )


def largest_increase(schedule: DataFrame, ks: list[int], how_many: int = 1) -> DataFrame:
    """(K, Relative_increase, Stage): the solutions just before the largest relative increases."""
    before = (F.col("Clusters_after_stage") + 1).alias("K")
    return schedule.select(before, "Relative_increase", F.col("Stage")).where(F.col("K").isin(*ks) & F.col("Relative_increase").isNotNull()).orderBy(F.desc("Relative_increase"), "Stage").limit(how_many)


def last_stages(schedule: DataFrame, how_many: int = 15) -> DataFrame:
    return schedule.orderBy(F.desc("Stage")).limit(how_many)


def silhouette_order(widths: DataFrame, gap_share: float = 0.02) -> DataFrame:
    """Adds Position: by cluster, width descending, id; clusters stand apart by max(1, round(share * n)).

    Positions are counted within clusters by ranges and shifted by the sizes of the clusters before.
    """
    sizes = widths.groupBy("Cluster").agg(F.count(F.lit(1)).alias("_n"))
    gap = widths.agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * gap_share)).cast("bigint").alias("_gap"))
    by = Window.orderBy("Cluster")
    shift = sizes.crossJoin(F.broadcast(gap)).select("Cluster", (F.sum("_n").over(by) - F.col("_n") + (F.row_number().over(by) - 1) * F.col("_gap")).alias("_shift"))
    within = ranked(widths, ("Cluster",), [-F.col("Silhouette_width"), "ID"], "_rank")
    return within.join(F.broadcast(shift), "Cluster").select(*widths.columns, (F.col("_rank") + F.col("_shift")).alias("Position"))


def cut_height(merges: DataFrame, k: int) -> DataFrame:
    """Height at which a tree falls into k: the mean of the (k - 1)th and kth largest heights."""
    top = merges.orderBy(F.desc("height"), F.desc("stage")).limit(k)
    ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("height"), F.desc("stage"))))
    return ranked.where(F.col("_r") >= k - 1).agg(F.avg("height").alias("Height"))


def leaf_order(staged: DataFrame) -> DataFrame:
    """(position, id) of the leaves of a tree ``stages(merges)`` with sizes n, from 0: the group of the smaller first case goes
    to the left at every merge.

    A group begins where its parent begins, or behind its left sibling. Those offsets are added up along the way
    to the root by pointer doubling: as many rounds as the tree's depth has binary digits.
    """
    leaf = lambda c: F.concat(F.lit("c"), c.cast("string"))
    node = lambda c: F.concat(F.lit("s"), c.cast("string"))
    swap = F.col("first_a") > F.col("first_b")
    size = staged.select(F.col("stage").alias("_s"), F.col("n").alias("_left"))
    side = staged.select(
        node(F.col("stage")).alias("up"),
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("l"), F.when(swap, F.col("first_b")).otherwise(F.col("first_a")).alias("fl"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("r"), F.when(swap, F.col("first_a")).otherwise(F.col("first_b")).alias("fr"),
    )
    name = lambda s, f: F.when(F.col(s) > 0, node(F.col(s))).otherwise(leaf(F.col(f)))
    met = side.join(size, side["l"] == size["_s"], "left")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    id_of = lambda s, f: F.when(F.col(s) == 0, F.col(f)).alias("id")
    nodes = met.select(name("l", "fl").alias("node"), "up", zero.alias("at"), id_of("l", "fl")).unionByName(
        met.select(name("r", "fr").alias("node"), "up", F.coalesce("_left", F.lit(1)).cast("bigint").alias("at"), id_of("r", "fr"))
    )
    nodes = materialize(nodes)
    while True:
        above = nodes.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("at").alias("_at"))
        joined = nodes.join(above, nodes["up"] == above["_n"], "left")
        nodes = materialize(joined.select("node", F.when(F.col("_n").isNotNull(), F.col("_up")).otherwise(none).alias("up"), (F.col("at") + F.coalesce("_at", zero)).alias("at"), "id"))
        if nodes.where("up is not null").isEmpty():
            return nodes.where("id is not null").select(F.col("at").alias("position"), "id")


def leaf_runs(leaves: DataFrame) -> DataFrame:
    """(cluster, Start, End): runs of one cluster along the leaves ``(position, cluster)``; leaves of one
    picture."""
    placed = leaves.withColumn("_p", F.row_number().over(Window.orderBy("position")))
    run = F.col("_p") - F.row_number().over(Window.partitionBy("cluster").orderBy("_p"))
    return placed.withColumn("_run", run).groupBy("cluster", "_run").agg(F.min("_p").alias("Start"), F.max("_p").alias("End")).drop("_run")
