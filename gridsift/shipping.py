"""This package for Python workers that cannot import it from a path of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(ship, "sent_to", None) == context.applicationId:
        return
    target = Path(tempfile.mkdtemp(prefix="gridsift-")) / "gridsift_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    ship.sent_to = context.applicationId
