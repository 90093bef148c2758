"""Gives executors this package, so that it need not be installed on them."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Serves the package's sources to the Python workers of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.TemporaryDirectory(prefix="varispark-")  # on the driver, which serves it as long as it runs
    _folders.append(folder)
    atexit.register(folder.cleanup)
    path = os.path.join(folder.name, f"{os.path.basename(top)}-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
