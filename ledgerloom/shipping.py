"""Sends this package to the Python workers of a session's executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's context, once; workers can then import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(path)
    context._ledgerloom_shipped = True
