"""Let Python workers import this package, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quern-code-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"quern-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quern_shipped = True
