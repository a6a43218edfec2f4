"""Versions of what a folder holds: numbered one-line files, of which the highest counts.

A version is written aside and then renamed to its number, which fails if the number is taken. So a reader sees the version
before or after, never none, and of two writers that start from the same version one gets an error and has changed
nothing. Data is written under fresh names before its version is; what no version names is not there for readers.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "versions"


class Conflict(Exception):
    """Another writer has made the version that this one wanted to make."""


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def numbers(spark: SparkSession, path: str) -> list[int]:
    files, place = _at(spark, f"{path}/{FOLDER}")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n) for n in names if n.isdigit())


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the version that counts; (0, {}) if there is none."""
    known = numbers(spark, path)
    if not known:
        return 0, {}
    return known[-1], json.loads(spark.read.text(f"{path}/{FOLDER}/{known[-1]:010d}").first()["value"])


def commit(spark: SparkSession, path: str, after: int, content: dict) -> int:
    """Make the version that follows after; Conflict if there is one already."""
    files, fresh = _at(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
    out = files.create(fresh, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    names = spark._jvm.org.apache.hadoop.fs
    context = names.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(names.Options.Rename, 0)
    try:
        context.rename(fresh, names.Path(f"{path}/{FOLDER}/{after + 1:010d}"), no_options)
    except Py4JJavaError as error:
        files.delete(fresh, False)
        if "FileAlreadyExistsException" in error.java_exception.toString():
            raise Conflict(f"{path} has a version {after + 1} already") from None
        raise
    return after + 1
