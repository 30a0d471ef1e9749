"""Python workers: sending them the package."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def _archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, f"{_PACKAGE.name}/{path.relative_to(_PACKAGE).as_posix()}")
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Send this package to all Python workers, once an application: Spark hands the archive to every executor."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="pixelyard-")  # the driver's; Spark serves the file from there
        path = os.path.join(folder, "pixelyard.zip")
        Path(path).write_bytes(_archive())
        context.addPyFile(path)
        _shipped.add(context.applicationId)
