import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("shelfmark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shared(spark):
    from shelfmark.session import new_shared_path

    return new_shared_path(spark, "test")


def column(spark, values, expression, kind="string"):
    """Evaluate an expression of column ``x`` over values, in order."""
    rows = [(n, v) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"n int, x {kind}")
    return [r["y"] for r in df.select("n", expression.alias("y")).orderBy("n").collect()]
