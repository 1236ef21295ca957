"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, tempfile.TemporaryDirectory] = {}  # by application; folders go when the driver ends


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of a session, once per application.

    Not needed where the package is installed on the workers or passed with ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.TemporaryDirectory(prefix="facetry-")
        archive = Path(folder.name) / "facetry.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped[app] = folder
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); a temporary folder only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="facetry-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/facetry-{name}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and a lost executor does not lose it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
