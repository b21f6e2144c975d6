"""What a session needs before queries run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hands this package to the executors through Spark's own file server, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).parent
        with tempfile.TemporaryDirectory() as folder:
            tree = Path(folder) / "tree"
            shutil.copytree(package, tree / package.name, ignore=shutil.ignore_patterns("__pycache__"))
            archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / package.name), "zip", tree)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark
