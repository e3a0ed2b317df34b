"""File metadata as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of every file below ``path``; file contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
