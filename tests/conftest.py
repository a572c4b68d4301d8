import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def example(spark):
    """150 cases in three groups of 50; the true group is g."""
    import numpy as np

    rng = np.random.default_rng(2026)
    means = np.array([[1, 4, 4], [4, 1, 2], [3, 4, 3]])
    x = np.concatenate([rng.normal(m, 0.55, (50, 3)) for m in means])
    rows = [(i + 1, f"P{i + 1:03d}", *map(float, v), i // 50 + 1) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "n bigint, ID string, Stress double, Support double, Engagement double, g int").cache()
