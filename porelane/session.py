"""Makes this package importable on Spark's Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to every executor, once a Spark application."""
    context = spark.sparkContext
    if getattr(context, "_porelane_shipped", False):
        return
    top = Path(__file__).parent
    with tempfile.TemporaryDirectory() as tmp:
        root = Path(tmp, "root")
        shutil.copytree(top, root / top.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{top.name}", "zip", root))
    context._porelane_shipped = True
