"""Random access to files of the shared folder from within tasks.

The folder is a URI that any executor can open: a mounted path, or a store for which
Arrow has a file system (``hdfs``, ``s3``, ``gs``, ``abfs``).
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def _locate(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^file:/", uri):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/*", "", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_for_writing(uri: str):
    """A new file; its folder is made if needed."""
    system, path = _locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def open_for_reading(uri: str):
    """A file with ``seek``, ``read`` and ``size``."""
    system, path = _locate(uri)
    return system.open_input_file(path)


def read_tasks(spark: SparkSession, total: int | None, each: int) -> int:
    """Tasks to read so much, each about as much as told, but enough for all cores."""
    return max(2 * spark.sparkContext.defaultParallelism, (total or 0) // each + 1)
