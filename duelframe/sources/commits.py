"""Commit records: small files that exactly one job can create.

Results are written to a folder of the attempt first. A record that names the attempt, with its files and their sizes,
is then created exclusively: the first job wins, the others get `FileExistsError` and what they wrote is
never read. Records are numbered; replacing a result on purpose creates the next number, also exclusively.
"""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def create_exclusively(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with this text; `FileExistsError` if it is there already.

    Local files are created by the operating system's exclusive open; elsewhere the file system's own create
    without overwriting is used, which HDFS and stores with conditional writes carry out atomically.
    """
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        with open(url.path, "x", encoding="utf-8") as out:
            out.write(text)
        return
    system, place = _files(spark, path)
    try:
        out = system.create(place, False)
    except (Py4JJavaError, CapturedException) as error:
        if "exist" in str(error).lower():
            raise FileExistsError(path) from error
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _number(name: str) -> int:
    return int(name.rsplit(".", 2)[-2])


def records(spark: SparkSession, folder: str, key: str) -> list[str]:
    """Names of the records of a key, oldest first: one for each time a result was replaced on purpose."""
    system, place = _files(spark, folder)
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return sorted((n for n in names if n.startswith(f"{key}.") and n.endswith(".json") and n[len(key) + 1 : -5].isdigit()), key=_number)


def current(spark: SparkSession, folder: str, key: str) -> dict | None:
    """The record in force, or none."""
    found = records(spark, folder, key)
    if not found:
        return None
    text = spark.read.text(f"{folder}/{found[-1]}", wholetext=True).first()["value"]
    return json.loads(text)


def manifest(spark: SparkSession, path: str) -> list[dict]:
    """Files of a result folder and their sizes; a result has as many as the tasks that wrote it."""
    system, place = _files(spark, path)
    return sorted(({"file": s.getPath().getName(), "bytes": s.getLen()} for s in system.listStatus(place) if s.isFile()), key=lambda f: f["file"])


def commit(spark: SparkSession, folder: str, key: str, content: dict, *, overwrite: bool = False) -> None:
    """Make a result current. Without `overwrite` it must be the first; with it, the next after those seen now."""
    known = records(spark, folder, key)
    if known and not overwrite:
        raise FileExistsError(f"{folder}/{known[-1]}")
    number = _number(known[-1]) + 1 if known else 1
    create_exclusively(spark, f"{folder}/{key}.{number:06d}.json", json.dumps(content, sort_keys=True))
