"""Small files that name what is complete: written under another name first, then renamed.

They go through the file system that Spark itself uses, so a shared or remote folder
is the same as a local one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file in one step; false if there is one of that name, which then stays."""
    place, fs = _place(spark, path)
    if fs.exists(place):
        return False
    hidden, _ = _place(spark, f"{place.getParent().toString()}/_{uuid.uuid4().hex}")
    stream = fs.create(hidden)
    stream.write(bytearray(text.encode()))
    stream.close()
    return bool(fs.rename(hidden, place))


def get(spark: SparkSession, path: str) -> str:
    place, fs = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished small files of a folder, in order; none if it is not there."""
    place, fs = _place(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(place)) if not n.startswith(("_", ".")))
