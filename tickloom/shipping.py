"""Puts this package on the executors, so that functions which run there can import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once to each application's executors, through the driver's own file server."""
    _smaller_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):  # else it is installed as an archive, as everywhere
        folder = tempfile.mkdtemp(prefix="tickloom-")  # the driver serves it from here until it ends
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "tickloom-package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(at, name), os.path.join("tickloom", os.path.relpath(os.path.join(at, name), top)))
        context.addPyFile(path)
    _sent.add(context.applicationId)


def _smaller_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: Spark's defaults may hold 64 MB each, several times over in the JVM and in Python.
    Settings that someone has changed are left."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)
