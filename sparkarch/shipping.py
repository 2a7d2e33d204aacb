"""Sending this package to the executors' Python workers, where the session doesn't have it already."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's files to the session, once; functions that run in Python workers are imported from there.

    Not needed with ``--py-files`` or a common PYTHONPATH, and harmless then.
    """
    context = spark.sparkContext
    if getattr(context, "_sparkarch_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sparkarch-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "sparkarch.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("sparkarch", os.path.relpath(full, package)))
    context.addPyFile(path)
    context._sparkarch_shipped = True
    return spark
