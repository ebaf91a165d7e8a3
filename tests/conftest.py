import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def chunks(spark):
    """Cut even tiny tables into many chunks."""
    spark.conf.set("cleanloom.scan.rowsPerChunk", "7")
    yield
    spark.conf.unset("cleanloom.scan.rowsPerChunk")


@pytest.fixture(scope="session")
def people(spark):
    rows = [(1, " Ann O'brien ", "ann@x.org", 30.0, 100.0, "2024-01-05"), (2, "BOB", None, None, 250.5, "01/07/2024"), (3, "cy", "bad", 41.0, None, "Jan 9, 2024"),
            (4, None, "dee@x.org", 30.0, 75.0, "soon"), (5, "", "eve@x.org", None, 5000.0, None)]
    return spark.createDataFrame(rows, "id int, name string, email string, age double, pay double, hired string")


def rows(df, *cols):
    df = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
