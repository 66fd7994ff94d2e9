"""Small tables written as numbered versions, so that a reader sees one state or the next.

A version is a folder `v=<number>`; it counts once Spark has marked it complete. The next number can be written by one
writer only, as a folder that is there makes the write fail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def fs_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the form name=value directly below a path."""
    fs, folder = fs_of(spark, path)
    if not fs.exists(folder):
        return []
    # Spark's files have no such names; a call less for each folder counts where there are many days.
    below = [p.toString() for p in spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(folder))]
    return sorted(p for p in below if "=" in p.rpartition("/")[2])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    found = []
    for folder in folders(spark, path):
        fs, done = fs_of(spark, f"{folder}/_SUCCESS")
        if fs.exists(done):
            found.append(int(folder.rpartition("v=")[2]))
    return sorted(found)


def version_path(path: str, version: int) -> str:
    return f"{path}/v={version:08d}"


def commit(df: DataFrame, path: str, version: int) -> None:
    """Write a version of few rows; fails where another writer has made it."""
    df.coalesce(1).write.mode("error").parquet(version_path(path, version))


def delete(spark: SparkSession, path: str) -> int:
    """Delete a folder; 1 if it was there."""
    fs, folder = fs_of(spark, path)
    return int(fs.delete(folder, True))
