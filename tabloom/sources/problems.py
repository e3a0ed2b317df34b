"""Problem tables from CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import fixed
from tabloom.functions.text import or_literal
from tabloom.operators.selection import split_missing
from tabloom.sources import splits

COLUMNS = ("Problem", "Solution")
QUOTING = {"quote": '"', "escape": '"', "multiLine": "true"}


def read_problems(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = COLUMNS, null_as: str | None = None
) -> DataFrame:
    """The named columns of quoted, multi-line CSV, matched by header name.

    Missing-value texts become NULL, or ``null_as``. A missing path or column is an analysis error.
    This reader takes a file whole: :func:`read_problems_split` reads one in many tasks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.csv(paths, header=True, multiLine=True, quote='"', escape='"')
    return raw.select(
        *[or_literal(F.when(~F.col(c).isin(list(fixed.MISSING_TEXTS)), F.col(c)), null_as).alias(c) for c in columns]
    )


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in names)


def read_problems_split(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = COLUMNS, null_as: str | None = None
) -> DataFrame:
    """``file, position`` and the named columns of quoted, multi-line CSV, each file in as many tasks as it has splits.

    ``position`` counts the records of a file; 0 is its header. Quotes stand around whole fields and are doubled inside, as
    :func:`write_problems` writes them. The names are those of the first file's header.
    """
    paths = [path] if isinstance(path, str) else list(path)
    names = spark.read.csv(paths, header=True, **QUOTING).columns
    rows = splits.records(spark, paths, splits.CSV).filter(F.col("position") > 0)
    parsed = rows.select("file", "position", F.from_csv("text", _ddl(names), QUOTING).alias("_row"))
    values = [F.col("_row")[c] for c in columns]
    missing = list(fixed.MISSING_TEXTS)
    return parsed.select(
        "file", "position", *[or_literal(F.when(~v.isin(missing), v), null_as).alias(c) for v, c in zip(values, columns)]
    )


def ingest_problems(
    spark: SparkSession, path: str | Sequence[str], out: str, split: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Turn CSV into parquet with a lasting ``example_id``; returns complete rows and incomplete rows.

    ``split`` reads every file in many tasks.

    The id is given out while writing and read back from the files afterwards, never computed again.
    """
    read = read_problems_split(spark, path).drop("file", "position") if split else read_problems(spark, path)
    read.withColumn("example_id", F.monotonically_increasing_id()).write.mode(
        "overwrite"
    ).parquet(out)
    return split_missing(spark.read.parquet(out).select("example_id", *COLUMNS), COLUMNS)


def write_problems(df: DataFrame, path: str, columns: Sequence[str] = COLUMNS) -> None:
    """Quoted CSV with a header per file; blanks around a text are part of it."""
    df.select(*columns).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
