"""Brings this package to Python workers that can't import it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per context: the package as a zip that executors fetch from the driver, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_foliospark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    work = tempfile.mkdtemp(prefix="foliospark-zip-")
    shutil.copytree(here, f"{work}/tree/foliospark", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{work}/foliospark", "zip", f"{work}/tree"))
    shutil.rmtree(f"{work}/tree")
    sc._foliospark_shipped = True
