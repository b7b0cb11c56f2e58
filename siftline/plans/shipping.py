"""Sends the package to executors that don't have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    if (app := spark.sparkContext.applicationId) in _sent:
        return
    folder = tempfile.mkdtemp()  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/siftline-{app}", "zip", ROOT, "siftline"))
    _sent.add(app)
