"""Makes the package importable on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless PYTHONPATH already names its folder."""
    package = Path(__file__).resolve().parent.parent
    named = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(package.parent) in named or app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="package-")
    archive = shutil.make_archive(os.path.join(folder, package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
