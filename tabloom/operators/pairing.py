"""Bringing rows of several engines, or parallel lists, side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_outputs(tuned: DataFrame, base: DataFrame, key: Sequence[str], base_output: str = "solution") -> DataFrame:
    """Each tuned output with the base output of the same example, ``base_solution``."""
    return tuned.join(base.select(*key, F.col(base_output).alias("base_solution")), list(key))


def side_by_side(df: DataFrame, key: Sequence[str], engine: str, engines: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per example with ``<engine>_<value>`` columns; absent engines are NULL."""

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col(engine) == name, F.col(value))).alias(f"{name}_{value}")

    return df.groupBy(*key).agg(*[of(e, v) for e in engines for v in values])


def zipped(columns: Sequence[str]) -> Column:
    """Parallel list columns as one list of structs, cut to the shortest list."""
    shortest = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    cut = [F.slice(F.col(c), F.lit(1), shortest).alias(c) for c in columns]
    return F.arrays_zip(*cut)


def unzip_rows(df: DataFrame, keep: Sequence[str], columns: Sequence[str], position: str = "position") -> DataFrame:
    """Rows of the zipped lists with their zero-based position."""
    exploded = df.select(*keep, F.posexplode(zipped(columns)).alias(position, "_row"))
    return exploded.select(*keep, position, *[F.col("_row")[c].alias(c) for c in columns])


def numbered(df: DataFrame, group: str, chunk: str, order: str, out: str = "position") -> DataFrame:
    """Zero-based position of each row within its group, along ``order``.

    ``chunk`` cuts a group into runs of rows that follow each other; rows are numbered within their chunk, and only the
    sizes of the chunks meet per group.
    """
    inside = F.row_number().over(Window.partitionBy(group, chunk).orderBy(order)) - 1
    sizes = df.groupBy(group, chunk).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = df.withColumn("_inside", inside).join(starts, [group, chunk])
    return placed.withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def chunked_left_join(left: DataFrame, right: DataFrame, on: str, chunk: Column) -> DataFrame:
    """Left join on a key that may hold a large share of the left rows.

    ``chunk`` cuts the left rows of a key into parts of bounded size. The right rows of a key are
    repeated once per part it has, so small keys cost nothing extra and a hot one is spread as widely
    as it is large.
    """
    parts = left.withColumn("_chunk", chunk)
    placed = parts.select(on, "_chunk").distinct().join(right, on)
    return parts.join(placed, [on, "_chunk"], "left").drop("_chunk")
