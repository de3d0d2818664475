"""Makes this package importable in Python workers, wherever the session's cluster runs them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers once a session, unless they have it on their path."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp()) / "blockflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((root / "blockflow").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
