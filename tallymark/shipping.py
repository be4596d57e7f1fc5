"""Make the package importable in Python workers where PYTHONPATH doesn't already do so."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def python_ready(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as --py-files would."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        stem = Path(tempfile.mkdtemp(prefix="tallymark-")) / "tallymark"
        spark.sparkContext.addPyFile(shutil.make_archive(str(stem), "zip", root, "tallymark"))
        _SHIPPED.add(app)
