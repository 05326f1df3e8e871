"""Small files beside the tables, by the file system that Spark itself uses for their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none where there is no such folder."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where))


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; one that is there already is an error."""
    system, where = _at(spark, path)
    stream = system.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def stamp(spark: SparkSession, path: str) -> str:
    """Sizes and times of the files below a path, as one text: it changes when the input does."""
    system, where = _at(spark, path)
    found = system.listFiles(where, True)
    seen = []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return "|".join(sorted(seen))
