"""Take the package along to the executors where they can't import it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package with the job, once for each context, unless workers find it on PYTHONPATH."""
    found = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(ROOT) in found or getattr(context, "_tessellum_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tessellum-ship-"))
    context.addPyFile(shutil.make_archive(f"{folder}/tessellum", "zip", ROOT, "tessellum"))
    context._tessellum_shipped = True
