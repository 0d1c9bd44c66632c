"""What a session needs to run the library's Python functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package where the driver has it on its own path only. Clusters get it by --py-files or an installation."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
