"""Small files next to the tables, through the file systems that Spark itself is configured with."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False, and nothing written, if it is."""
    _, place, files = _at(spark, path)
    try:
        out = files.create(place, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(place):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str] | None:
    """Names in a folder, None if there is no such folder."""
    _, place, files = _at(spark, folder)
    if not files.exists(place):
        return None
    return [status.getPath().getName() for status in files.listStatus(place)]


def read(spark: SparkSession, path: str) -> str:
    jvm, place, files = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    _, place, files = _at(spark, path)
    return bool(files.exists(place))


def delete(spark: SparkSession, folder: str) -> None:
    _, place, files = _at(spark, folder)
    files.delete(place, True)
