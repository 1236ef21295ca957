import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import facetry

    facetry.ship_package(session)
    yield session
    session.stop()


def features(spark, block, groups=None, labels=None):
    """A feature table from a numpy block; row ids are 0..n-1."""
    rows = [
        (i, int(groups[i]) if groups is not None else 0, [float(v) for v in x], int(labels[i]) if labels is not None else -1)
        for i, x in enumerate(block)
    ]
    return spark.createDataFrame(rows, "row_id bigint, group_id int, features array<double>, label int")
