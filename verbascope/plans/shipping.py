"""The package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the session's executors once, unless their Python path or folder has it."""
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT
    name = spark.sparkContext.applicationId
    if on_path or name in _shipped:
        return
    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(), ROOT.joinpath("verbascope").name), "zip", ROOT, "verbascope")
    spark.sparkContext.addPyFile(packed)
    _shipped.add(name)
