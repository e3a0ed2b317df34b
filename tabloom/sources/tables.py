"""Named datasets with splits, stable keys, and in-memory columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import fixed
from tabloom.operators.selection import head, parse_split


def scan_dataset(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a parquet dataset given by its path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def with_file_key(spark: SparkSession, path: str) -> DataFrame:
    """A parquet dataset without a key of its own, keyed by ``file, row``."""
    df = spark.read.parquet(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return df.select(*place, *df.columns)


def load_split(
    df: DataFrame, key: Sequence[str], split: str = f"train[:{fixed.HEAD_ROWS}]", split_column: str = "split"
) -> DataFrame:
    """The rows of ``name`` or the first ``n`` of them for ``name[:n]``.

    A table without a split column holds the one split it is asked for.
    """
    name, rows = parse_split(split)
    if split_column in df.columns:
        df = df.filter(F.col(split_column) == name).drop(split_column)
    return df if rows is None else head(df, rows, key)


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence[Any]], schema: str) -> DataFrame:
    """A small literal dataset given as parallel lists of equal length."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*columns.values())), schema)
