"""Sends this package to the executors, where their Python path lacks it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """addPyFile of the package, once an application; nothing if PYTHONPATH holds it already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="granary-")) / "granary_package.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(ROOT.glob("granary/**/*.py")):
            archive.write(source, source.relative_to(ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
