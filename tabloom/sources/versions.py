"""Numbered files that are made once: the order in which writers publish, and what readers go by.

The driver makes a version file only if it is absent, so of two writers that want the same number one takes the next. What a
version names was written before, below a path of its own, so a reader sees all of it or nothing. A file without a readable
line, left by a writer that was lost between making and filling it, is a number not used.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DIGITS = 20
ATTEMPTS = 1_000


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def make_once(spark: SparkSession, path: str, line: str) -> bool:
    """Create the file with one line; False if it is there already."""
    files, place = _file_system(spark, path)
    data = bytearray(line.encode() + b"\n")
    if files.getScheme() == "file":
        local = place.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as out:
            out.write(data)
        return True
    try:
        out = files.create(place, False)
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(data)
    finally:
        out.close()
    return True


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The version numbers in use, ascending; none for a missing folder."""
    files, place = _file_system(spark, folder)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def version_file(folder: str, number: int) -> str:
    return f"{folder}/{number:0{DIGITS}d}.json"


def commit(spark: SparkSession, folder: str, entry: Mapping[str, Any]) -> int:
    """Publish the entry under the next free number, which is returned."""
    line = json.dumps(entry)
    for _ in range(ATTEMPTS):
        number = 1 + max(numbers(spark, folder), default=-1)
        if make_once(spark, version_file(folder, number), line):
            return number
    raise RuntimeError(f"no free version below {folder} after {ATTEMPTS} attempts")


def entry_of(spark: SparkSession, folder: str, number: int) -> dict | None:
    """What a version says, or None if its writer was lost."""
    files, place = _file_system(spark, version_file(folder, number))
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None
