"""Makes the package known to the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Spark serves the archive from the driver. Where the package is installed on all machines this isn't needed, and does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="doctax-"), "doctax.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name, file.relative_to(root)))
    context.addPyFile(archive)
    _done.add(context.applicationId)
