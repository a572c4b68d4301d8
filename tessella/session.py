"""Making the library importable in executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the Python path of all executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    handle, target = tempfile.mkstemp(prefix="tessella-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. If that is unset, a temporary folder serves
    a local session; on a cluster it is an error, as executors would not see it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        configured = sc.getCheckpointDir()
    return configured.rstrip("/")


#: Folders in which tables are written at present, the innermost last.
_folders: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{_folders[-1] if _folders else shared_dir(df.sparkSession)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``materialize`` writes inside is deleted at the end, but for what the given function writes."""
    outer = _folders[-1] if _folders else shared_dir(spark)
    folder = f"{outer}/scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{outer}/tessella-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    _folders.append(folder)
    try:
        yield keep
    finally:
        _folders.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def indexed(cases: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``index``, 0, 1, ... in order of the key, without a global window: ranges of the key are dealt
    to partitions, whose sizes are then added up. The deal is written once: its bounds come from a sample, and
    a second pass over other columns could draw others."""
    ranged = materialize(cases.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    totals = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = totals.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    return ranged.join(F.broadcast(starts), "_p").withColumn("index", F.col("_s") + F.col("_in")).drop("_p", "_in", "_s")
