"""Existence, listing and removal of folders on whatever file system a path names."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import SparkSession

AT_ONCE = 16  # requests to a file system side by side
Item, Result = TypeVar("Item"), TypeVar("Result")


def each(act: Callable[[Item], Result], items: Iterable[Item]) -> list[Result]:
    """Act on every item, several at once: a store answers many small requests in the time of a few."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(act, items))


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _open(spark, path)
    return fs.exists(hadoop_path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob."""
    fs, hadoop_path = _open(spark, pattern)
    found = fs.globStatus(hadoop_path)
    return sorted(status.getPath().toString() for status in found or [])


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _open(spark, path)
    fs.delete(hadoop_path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, hadoop_path = _open(spark, folder)
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))


def stamped_names(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names in a folder with what tells a rewritten file from the one before: its time and length."""
    fs, hadoop_path = _open(spark, folder)
    if not fs.exists(hadoop_path):
        return {}
    return {
        s.getPath().getName(): f"{s.getPath().getName()}:{s.getModificationTime()}:{s.getLen()}"
        for s in fs.listStatus(hadoop_path)
    }


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _open(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, which readers pass over."""
    folder, name = path.rsplit("/", 1)
    fs, unfinished = _open(spark, f"{folder}/_{name}")
    stream = fs.create(unfinished, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(unfinished, target)
