"""Declared schemas of the tables this library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

GENERATION_FILE = T.StructType(
    [
        T.StructField("problem", T.StringType()),
        T.StructField("original_solution", T.StringType()),
        T.StructField("generated_solution", T.StringType()),
        T.StructField("solution", T.StringType()),
    ]
)

BASE_OUTPUT_FILE = T.StructType(
    [T.StructField("problem", T.StringType()), T.StructField("solution", T.StringType())]
)

# What a model call adds to its input row.
COMPLETION_FIELDS = [
    T.StructField("completion", T.StringType()),
    T.StructField("latency_us", T.LongType()),
    T.StructField("first_token_us", T.LongType()),
    T.StructField("error", T.StringType()),
]

# What a model that streams its answer adds to that.
PART_FIELDS = [T.StructField("last_token_us", T.LongType()), T.StructField("parts", T.LongType())]

# When a call was sent, in microseconds of the epoch.
SENT_FIELD = T.StructField("sent_us", T.LongType())

# What a judge call adds to its input row.
JUDGEMENT_FIELDS = [T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]

EXPERIMENT_METADATA = T.StructType(
    [
        T.StructField("inference_output_file", T.StringType()),
        T.StructField("evaluation_type", T.StringType()),
        T.StructField("total_comparisons", T.LongType()),
        # Absent from documents of other writers, which list an experiment in one entry.
        T.StructField("experiment_id", T.StringType()),
        T.StructField("part", T.LongType()),
    ]
)

EXPERIMENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("comparisons", T.ArrayType(T.StringType())),
        T.StructField("metadata", EXPERIMENT_METADATA),
    ]
)

# Both layouts of a log document side by side: a list of experiments, or one bare experiment.
LOG_DOCUMENT = T.StructType(
    [T.StructField("experiments", T.ArrayType(EXPERIMENT)), *EXPERIMENT.fields, T.StructField("_corrupt", T.StringType())]
)

COMPARISON_FILE = T.StructType(
    [T.StructField("evaluation_type", T.StringType()), T.StructField("raw", T.StringType())]
)
