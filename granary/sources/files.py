"""Small text files in any store that Spark reads: created once, or replaced by one rename."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def exists(spark: SparkSession, path: str) -> bool:
    where, store, _ = _at(spark, path)
    return store.exists(where)


def names(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The names in a folder that end so, in order; none if there is no such folder."""
    where, store, _ = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where) if x.getPath().getName().endswith(suffix)) if store.exists(where) else []


def read(spark: SparkSession, path: str) -> str:
    where, store, jvm = _at(spark, path)
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _written(store, where, text: str, overwrite: bool) -> None:
    stream = store.create(where, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there yet; False, and no change, if it is."""
    where, store, _ = _at(spark, path)
    try:
        _written(store, where, text, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception) or store.exists(where):
            return False
        raise
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file, then renames over it: a reader sees the old text or the new one."""
    where, store, jvm = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    _written(store, beside, text, True)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(store.makeQualified(beside), store.makeQualified(where), option)
