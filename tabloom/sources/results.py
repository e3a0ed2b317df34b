"""Generation results, base outputs and judge responses as files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.schemas import BASE_OUTPUT_FILE, GENERATION_FILE
from tabloom.session import ship
from tabloom.sources import splits

# Text in one file that a single task writes.
FILE_BYTES = 256 << 20


def result_columns(df: DataFrame, problem: str = "Problem", solution: str = "Solution") -> list:
    """The projection of a generation record, for ``df.select``."""
    return [
        F.col(problem).alias("problem"), F.col(solution).alias("original_solution"), F.col("generated_solution"),
    ]


def write_results(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Generation results of any number of engines, one directory per engine.

    Overwrites only the engines present in ``df``.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("engine").format(form).save(path)


def read_results(spark: SparkSession, path: str, multi_line: bool = True, key: T.StructType | None = None) -> DataFrame:
    """Generation records of JSON array files, or of JSON lines when ``multi_line`` is off.

    The generated text is found under either name it is written with. Lines split over tasks; array files do with
    :func:`read_json_array`.
    With ``key``, the fields that tell examples apart, these and the engine, from the folder's name, come along.
    """
    own = [] if key is None else [*key.fields, T.StructField("engine", T.StringType())]
    read = spark.read.schema(T.StructType([*own, *GENERATION_FILE.fields])).json(path, multiLine=multi_line)
    generated = F.coalesce("generated_solution", "solution").alias("generated_solution")
    return read.select(*[f.name for f in own], "problem", "original_solution", generated)


def read_json_array(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, level: int = 1) -> DataFrame:
    """``file, position`` and the fields of the objects of JSON array files, each file in as many tasks as it has splits.

    ``position`` is the place in the list. With ``level`` 2 the objects are those of a list inside an object, as in a log document.
    An object that does not parse has null fields.
    """
    rows = splits.records(spark, path, splits.json_elements(level))
    return rows.select("file", "position", F.from_json("text", schema).alias("_object")).select("file", "position", "_object.*")


def in_files(df: DataFrame, texts: Sequence[str], size: int = FILE_BYTES) -> DataFrame:
    """The rows dealt to as many tasks as files of about ``size`` bytes of text ask for: one if they are few."""
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    total = df.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    return df.repartition(max(1, -(-total // size)))


def write_json_array(df: DataFrame, path: str, head: str = "[", tail: str = "]") -> None:
    """The rows as JSON arrays, one file per task, an object a line; tasks without rows leave no array."""
    ship(df.sparkSession)

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, first = None, True
        for batch in batches:
            lines = []
            for value in batch.column(0).to_pylist():
                if waiting is not None:
                    lines.append((head if first else "") + waiting + ",")
                    first = False
                waiting = value
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([(head if first else "") + waiting + tail], pa.string())], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def read_base_outputs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(BASE_OUTPUT_FILE).json(path, multiLine=multi_line)


def with_list_position(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of JSON array files with their place in the file, the key such files lack."""
    read = spark.read.schema(schema).json(path, multiLine=True)
    tagged = read.withColumn("file", F.col("_metadata.file_name")).withColumn("_seen", F.monotonically_increasing_id())
    placed = F.row_number().over(Window.partitionBy("file").orderBy("_seen")) - 1
    return tagged.withColumn("position", placed).drop("_seen")


def in_input_order(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows in key order, for presentation only: nothing in between relies on the order of rows."""
    return df.orderBy(*key)


def write_comparisons(df: DataFrame, path: str) -> None:
    """Raw judge responses, kept as text next to their keys."""
    df.write.mode("overwrite").json(path)
