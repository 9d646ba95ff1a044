"""Small files in folders that the driver and all executors share, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    if not _system(spark, path).exists(_path(spark, path)):
        return None
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old text or the new one, never a part or nothing."""
    jvm = spark._jvm
    new = f"{path}.{uuid.uuid4().hex}"
    stream = _system(spark, new).create(_path(spark, new), True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    target = _path(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_system(spark, path).getUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, new), target, how)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    if not _system(spark, folder).exists(_path(spark, folder)):
        return []
    return sorted(s.getPath().getName() for s in _system(spark, folder).listStatus(_path(spark, folder)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all that is in it."""
    _system(spark, path).delete(_path(spark, path), True)
