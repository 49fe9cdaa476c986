"""Sends this package to the executors, so that functions that tasks call can be imported there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip to the session's application, once; returns the session."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        top = Path(__file__).resolve().parent
        if top.is_dir():  # else the package was itself shipped as a zip
            place = Path(tempfile.mkdtemp(prefix="package-")) / "rasterloom-package.zip"
            with zipfile.ZipFile(place, "w") as held:
                for path in sorted(top.rglob("*.py")):
                    held.write(path, Path(top.name) / path.relative_to(top))
            context.addPyFile(str(place))
        _sent.add(context.applicationId)
    return spark
