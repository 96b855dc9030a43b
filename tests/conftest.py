import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FILES = "project string, path string, size bigint, mtime timestamp, content string"


@pytest.fixture
def make_files(spark):
    def make(contents: dict[str, str | None], project: str = "p", size: int | None = None):
        rows = [(project, p, len(c or "") if size is None else size, None, c) for p, c in contents.items()]
        return spark.createDataFrame(rows, FILES)

    return make


@pytest.fixture
def one(spark):
    """Evaluate a column on single values of ``x``; gives the list of results."""
    def run(build, *values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[0] for r in df.select(build(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]

    return run
