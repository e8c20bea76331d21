"""Folder checks and deletes through Hadoop's file system, so any shared store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def resolve(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def has_data(spark: SparkSession, path: str) -> bool:
    """True if the folder exists and holds a partition folder or a data file."""
    files, location = resolve(spark, path)
    if not files.exists(location):
        return False
    return any(not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(location))


def subfolders(spark: SparkSession, path: str) -> list[str]:
    files, location = resolve(spark, path)
    if not files.exists(location):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(location) if s.isDirectory())


def drop_folder(spark: SparkSession, path: str) -> bool:
    files, location = resolve(spark, path)
    return files.exists(location) and files.delete(location, True)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced if it is there."""
    files, location = resolve(spark, path)
    stream = files.create(location, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_small(spark: SparkSession, folder: str) -> dict[str, str]:
    """The names and texts of a folder's small files; none if there is no folder."""
    files, location = resolve(spark, folder)
    if not files.exists(location):
        return {}
    found = {}
    for status in files.listStatus(location):
        name = status.getPath().getName()
        if status.isFile() and not name.startswith((".", "_")):
            stream = files.open(status.getPath())
            found[name] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return found
