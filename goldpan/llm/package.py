"""Makes this package importable in the Python workers, as ``--py-files`` would."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Once per application; called by every operator with Python functions."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="goldpan-code-")), "goldpan.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
