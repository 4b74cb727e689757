"""Hands the package to the executors of a session that was started without it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()

#: Bytes that a byte of the written tables, which are compressed, stands for in memory.
FILE_FACTOR = 10
#: The same for rows on their way through a shuffle: packed closer, and hashed when broadcast.
SHUFFLE_FACTOR = 16


def steady(spark: SparkSession) -> None:
    """Spark broadcasts a table when it takes it for small, by the size of its files or of its
    shuffled rows, both compressed.  A table under the threshold then unfolds to hundreds of
    megabytes on the driver; these settings let the threshold hold for what it takes in memory.
    Values that the session has already stay."""
    if spark.conf.get("spark.sql.sources.fileCompressionFactor", None) is None:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit if limit < 0 else limit // SHUFFLE_FACTOR)


def ship(spark: SparkSession) -> None:
    """Python workers import the package by name, so they need it too.  An installed copy or
    a PYTHONPATH will do; without either, Spark's own file server brings them an archive.
    Once per application; harmless where the package is there already."""
    context = spark.sparkContext
    steady(spark)
    if context.applicationId in _done:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="bookloom-"), "bookloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _done.add(context.applicationId)
