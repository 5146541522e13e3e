"""Small files and folders: on any of Hadoop's file systems for the driver, through Arrow's for tasks."""

from __future__ import annotations

import re

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def arrow_path(spark: SparkSession, path: str) -> str:
    """A path as Arrow's file systems take it, on the file system where Hadoop would look for it."""
    where, fs = located(spark, path)
    uri = fs.makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else uri.toString()


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a path that Spark names, and the path in it; for tasks."""
    return arrow_fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder."""
    where, fs = located(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = located(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file whole or not at all; false if it is there already."""
    where, fs = located(spark, path)
    new, _ = located(spark, f"{where.getParent()}/.{where.getName()}.new")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(where) or not fs.rename(new, where):
        fs.delete(new, False)
        return False
    return True


def delete(spark: SparkSession, path: str) -> bool:
    where, fs = located(spark, path)
    return fs.delete(where, True)
