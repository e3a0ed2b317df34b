"""Scores, timings, sizes and run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scores import is_valid, is_whole, parsed, whole_document
from tabloom.functions.text import mean_or_zero
from tabloom.operators.selection import once

MEGABYTE = 1024 * 1024


def with_scores(df: DataFrame, raw: str = "raw", strict: bool = True) -> DataFrame:
    """Adds ``first_score, second_score, valid``; an invalid row carries no scores.

    Text after the JSON document voids the row too, unless ``strict`` is off.
    """
    if strict:
        document = once(df, whole_document(F.col(raw)), "_document")
        read = document.withColumn("_scores", F.get("_document", F.lit(0)))
        valid = is_whole(F.col("_document")) & is_valid(F.col(raw), F.col("_scores"))
    else:
        read = once(df, parsed(F.col(raw)), "_scores")
        valid = is_valid(F.col(raw), F.col("_scores"))
    marked = read.withColumn("valid", F.coalesce(valid, F.lit(False)))
    scores = [
        F.when(F.col("valid"), F.col("_scores")[n]).alias(n) for n in ("first_score", "second_score")
    ]
    return marked.select(*df.columns, *scores, "valid")


def score_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean scores over valid rows, their count, and the count of all rows, in one pass.

    Without any valid row the means are zero.
    """
    return scored.groupBy(*by).agg(
        mean_or_zero(F.col("first_score")).alias("finetuned_avg"),
        mean_or_zero(F.col("second_score")).alias("base_avg"),
        F.count_if("valid").alias("total_comparisons"),
        F.count("*").alias("all_comparisons"),
    )


def latency_summary(df: DataFrame, by: Sequence[str] = ("engine",), latency: str = "latency_us") -> DataFrame:
    """Total, mean and extreme times; summed as whole microseconds, so the order of rows is immaterial.

    The mean time to the first token is added where it was measured, and the mean time between parts where a stream was timed.
    """
    first = "first_token_us"
    to_first = [(F.sum(first) / F.count(first)).alias("mean_first_token_us")] if first in df.columns else []
    if {"last_token_us", "parts"} <= set(df.columns):
        between = F.try_divide(F.sum(F.col("last_token_us") - F.col(first)), F.sum(F.greatest(F.col("parts") - 1, F.lit(0))))
        to_first.append(between.alias("mean_between_us"))
    return df.groupBy(*by).agg(
        F.sum(latency).alias("total_us"),
        (F.sum(latency) / F.count(latency)).alias("mean_us"),
        F.min(latency).alias("min_us"),
        F.max(latency).alias("max_us"),
        F.count(latency).alias("samples"),
        *to_first,
    )


def run_status(
    steps: DataFrame, run: Sequence[str] = ("run_id",), step: str = "step", ok: str = "ok", optional: Sequence[str] = ("vllm_evaluation",)
) -> DataFrame:
    """One status per run: if only ``optional`` steps failed it is a partial success."""
    extra = F.col(step).isin(list(optional))
    essential = F.coalesce(F.bool_and(F.when(~extra, F.col(ok))), F.lit(True))
    last = F.coalesce(F.bool_and(F.when(extra, F.col(ok))), F.lit(True))
    status = F.when(~essential, "failed").when(~last, "partial_success").otherwise("success")
    return steps.groupBy(*run).agg(status.alias("status"), F.count("*").alias("steps"))


def shape(df: DataFrame) -> DataFrame:
    """``row_count, column_count``."""
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


def total_megabytes(files: DataFrame) -> DataFrame:
    """Size of a scanned file tree."""
    return files.agg(
        F.count("*").alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / float(MEGABYTE)).alias("megabytes")
    )
