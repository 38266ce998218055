"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per session.

    Functions of Arrow operators are found by name on the workers, which need
    not have the package on their path.  Spark hands the file to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_has_lagloom", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lagloom-"), "lagloom_source.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._has_lagloom = True
