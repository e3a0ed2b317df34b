"""The history of judged experiments.

A log is two folders below one path: ``comparisons``, one row per judge response in folders per append, evaluation type and
experiment, and ``versions``, one small file per append that names it and its experiments.
A comparison counts if the last version of its experiment names its append. Appending never touches other files, so readers
see an append whole or not at all; repeating one replaces that experiment, and of parallel writers each gets a version of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.text import whole
from tabloom.operators.ordering import key_position
from tabloom.operators.selection import split_by
from tabloom.schemas import EXPERIMENT, LOG_DOCUMENT
from tabloom.sources import results, versions

EXPERIMENTS = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("inference_output_file", T.StringType()),
        T.StructField("evaluation_type", T.StringType()),
        T.StructField("total_comparisons", T.LongType()),
        T.StructField("experiment_id", T.StringType()),
    ]
)
ENTRY_ROWS = 1_000


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType, folders: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/{folders}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_experiments(
    comparisons: DataFrame, log: str, experiments: Mapping[str, tuple[str, str]], timestamp: str
) -> str:
    """Add the experiments of one run in one write and one version; returns the folder written.

    ``comparisons`` holds ``evaluation_type``, key columns and ``raw``; ``experiments`` gives each evaluation type its experiment id and
    the file of its results. Types that are not named there are left out.
    """
    spark, append = comparisons.sparkSession, uuid.uuid4().hex
    ids = F.create_map(*[F.lit(x) for kind, (name, _) in experiments.items() for x in (kind, name)])
    own = comparisons.filter(F.col("evaluation_type").isin(list(experiments))).withColumns(
        {"experiment_id": ids[F.col("evaluation_type")]}
    )
    # A folder of its own: jobs that write to one folder at the same time remove each other's files.
    folder = f"{log}/comparisons/append_id={append}"
    own.write.partitionBy("evaluation_type", "experiment_id").parquet(folder)
    stored = spark.read.schema("evaluation_type string").parquet(folder)
    found = {r["evaluation_type"]: r["count"] for r in stored.groupBy("evaluation_type").count().collect()}
    entries = [
        {
            "timestamp": timestamp, "inference_output_file": file, "evaluation_type": kind,
            "total_comparisons": found.get(kind, 0), "experiment_id": name,
        }
        for kind, (name, file) in experiments.items()
    ]
    versions.commit(spark, f"{log}/versions", {"append_id": append, "experiments": entries})
    return folder


def append_experiment(
    comparisons: DataFrame, log: str, experiment_id: str, evaluation_type: str, inference_output_file: str, timestamp: str
) -> None:
    """Add one experiment; ``comparisons`` holds key columns and ``raw``."""
    named = comparisons.withColumn("evaluation_type", F.lit(evaluation_type))
    append_experiments(named, log, {evaluation_type: (experiment_id, inference_output_file)}, timestamp)


def _last_versions(spark: SparkSession, log: str) -> DataFrame:
    """``append_id`` and the fields of an experiment, as its last version has them."""
    folder = f"{log}/versions"
    schema = T.StructType([T.StructField("append_id", T.StringType()), T.StructField("experiments", T.ArrayType(EXPERIMENTS))])
    if not versions.numbers(spark, folder):
        return spark.createDataFrame([], T.StructType([schema["append_id"], *EXPERIMENTS.fields]))
    named = spark.read.schema(schema).json(folder).select("append_id", F.col("_metadata.file_name").alias("_version"), F.inline("experiments"))
    last = named.filter(F.col("append_id").isNotNull()).groupBy("experiment_id").agg(
        F.max_by(F.struct("append_id", *[n for n in EXPERIMENTS.fieldNames() if n != "experiment_id"]), "_version").alias("_last")
    )
    return last.select("_last.*", "experiment_id").select("append_id", *EXPERIMENTS.fieldNames())


def read_experiments(spark: SparkSession, log: str) -> DataFrame:
    """One row per finished experiment."""
    return _last_versions(spark, log).drop("append_id")


def read_comparisons(spark: SparkSession, log: str, key: T.StructType) -> DataFrame:
    """Responses of finished experiments."""
    tail = [T.StructField(n, T.StringType()) for n in ("raw", "append_id", "evaluation_type", "experiment_id")]
    rows = _read_or_empty(spark, f"{log}/comparisons", T.StructType([*key.fields, *tail]), "append_id=*")
    own = _last_versions(spark, log).select("experiment_id", "evaluation_type", "append_id")
    kept = rows.join(own, ["experiment_id", "evaluation_type", "append_id"], "left_semi")
    return kept.select("experiment_id", *key.fieldNames(), "raw", "evaluation_type")


def experiment_count(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("evaluation_type").agg(F.count_distinct("experiment_id").alias("experiments"))


def entries(
    comparisons: DataFrame, key: Sequence[str], timestamp: str, inference_output_file: str, run_id: str = "", rows: int = ENTRY_ROWS
) -> DataFrame:
    """Nested log entries ``timestamp, comparisons, metadata`` for exchange with document readers.

    An experiment, one per evaluation type, is one entry as long as it has no more than ``rows`` responses. A larger
    one comes in parts in key order, so no task gathers it whole; each part names the experiment, its place and the
    size of the whole, so that :func:`assembled` counts it once and puts it together again.
    """
    pair = ["evaluation_type", *key]
    places = key_position(comparisons.select(*pair), pair, out="_position")
    sizes = places.groupBy("evaluation_type").agg(F.min("_position").alias("_first"), F.count("*").alias("_n"))
    parts = comparisons.join(places, pair).join(sizes, "evaluation_type").withColumn(
        "part", whole(F.col("_position") - F.col("_first"), rows)
    )
    listed = parts.groupBy("evaluation_type", "part").agg(
        F.sort_array(F.collect_list(F.struct("_position", "raw"))).alias("_rows"), F.first("_n").alias("_n")
    )
    metadata = F.struct(
        F.lit(inference_output_file).alias("inference_output_file"), F.col("evaluation_type"),
        F.col("_n").alias("total_comparisons"),
        F.concat_ws("-", F.lit(run_id or None).cast("string"), F.col("evaluation_type")).alias("experiment_id"), F.col("part"),
    )
    return listed.select(
        F.lit(timestamp).alias("timestamp"), F.transform("_rows", lambda r: r["raw"]).alias("comparisons"),
        metadata.alias("metadata"),
    )


def assembled(experiments: DataFrame) -> DataFrame:
    """``experiment_id, evaluation_type, responses, total_comparisons`` per experiment of upgraded entries.

    Entries without an id are an experiment each, named by file and timestamp and a number of their own.
    """
    own = F.concat_ws(":", "file", "timestamp", F.monotonically_increasing_id().cast("string"))
    named = experiments.withColumn("experiment_id", F.coalesce(F.col("metadata.experiment_id"), own))
    return named.groupBy("experiment_id", F.col("metadata.evaluation_type").alias("evaluation_type")).agg(
        F.sum(F.size("comparisons")).cast("long").alias("responses"), F.max("metadata.total_comparisons").alias("total_comparisons")
    )


def upgraded(documents: DataFrame) -> DataFrame:
    """One row per experiment of parsed log documents in either layout."""
    single = F.struct(*[F.col("_log")[f.name].alias(f.name) for f in EXPERIMENT.fields])
    return documents.select("file", F.inline(F.coalesce(F.col("_log")["experiments"], F.array(single))))


def read_log_documents(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Experiments of JSON log documents, and ``file, document`` of unreadable ones; none for a missing path.

    A document is a file, or a line when ``multi_line`` is off.
    """
    try:
        read = spark.read.text(path, wholetext=multi_line).select(
            F.col("_metadata.file_name").alias("file"), F.col("value").alias("document")
        )
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], "file string, document string")
    if not multi_line:
        read = read.filter(F.trim("document") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    documents = read.withColumn("_log", F.from_json("document", LOG_DOCUMENT, options))
    sound, broken = split_by(documents, F.col("_log").isNotNull() & F.col("_log")["_corrupt"].isNull())
    return upgraded(sound), broken.select("file", "document")


def read_log_arrays(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, position`` and the experiments of log documents that list them, each file in as many tasks as it has splits.

    A document in the old layout is one experiment and lists none: it is read by :func:`read_log_documents`.
    """
    return results.read_json_array(spark, path, EXPERIMENT, level=2)
