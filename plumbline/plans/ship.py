"""Sending the package to the executors of a session whose Python does not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each context. Spark's file server hands it out."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="plumbline-ship-"), "plumbline.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.glob("plumbline/**/*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(at)
    sc._plumbline_shipped = True
