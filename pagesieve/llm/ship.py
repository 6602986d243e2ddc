"""Makes this package importable in the tasks of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import pagesieve

NAME = "pagesieve-package.zip"
#: Bytes of rows that a Python task is handed at once; texts may be long, and workers are small.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each context, and keep their batches small."""
    spark.conf.set(*BATCH)
    context = spark.sparkContext
    if NAME in getattr(context, "_python_includes", []):
        return
    top = os.path.dirname(os.path.abspath(pagesieve.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pagesieve-"), NAME)
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(top)))
    context.addPyFile(path)
