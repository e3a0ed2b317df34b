"""Calling generators and judges over whole tables.

This is the one place where rows leave the JVM. Rows travel as Arrow batches, columns that are only
carried along are handed through untouched, and the plug-in is built once per task. A call that fails
becomes an ``error`` value of its row. Tasks may run more than once, so store the result before using
it twice. :func:`in_rounds` stores a long series of calls slice by slice, so that a lost executor or
job repeats little.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import fixed
from tabloom.functions.text import cut_at_stop, without_echo
from tabloom.operators.plugins import Generator, Judge, RateLimit
from tabloom.schemas import COMPLETION_FIELDS, JUDGEMENT_FIELDS, PART_FIELDS, SENT_FIELD
from tabloom.session import ship

CALL_ROWS = 64
# Rows of a task of calls where tasks are cut by size: what a lost executor has called again.
TASK_ROWS = 2_000

Caller = Callable[[Any, Sequence[str]], list[tuple]]
Step = Callable[[DataFrame], DataFrame]


def _failure(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def _completions(timed: bool) -> Caller:
    def call(generator: Generator, prompts: Sequence[str]) -> list[tuple]:
        start = time.perf_counter_ns()
        answers = list(generator.generate(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} completions for {len(prompts)} prompts")
        share = (time.perf_counter_ns() - start) // (1000 * max(1, len(prompts)))
        return [(*((a.last_token_us, a.parts) if timed else ()), a.text, share, a.first_token_us, None) for a in answers]

    return call


def _judgements(sent: bool) -> Caller:
    def call(judge: Judge, prompts: Sequence[str]) -> list[tuple]:
        start = time.time_ns() // 1000
        answers = list(judge.judge(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} responses for {len(prompts)} prompts")
        return [(*((start,) if sent else ()), a, None) for a in answers]

    return call


def _guarded(call: Caller, plugin: Any, prompts: Sequence[str], width: int, limit: RateLimit | None) -> list[tuple]:
    """Call for all prompts; when that fails, one by one, so that only the bad rows carry an error.

    Under a rate every prompt is a call of its own, sent when it is due.
    """
    if limit is not None and len(prompts) == 1:
        limit.wait()
    if limit is None or len(prompts) == 1:
        try:
            return call(plugin, prompts)
        except Exception as whole:  # noqa: BLE001 - any plug-in failure is data here
            if len(prompts) == 1:
                return [(None,) * (width - 1) + (_failure(whole),)]
    return [_guarded(call, plugin, [p], width, limit)[0] for p in prompts]


def _run(
    df: DataFrame, make: Callable[[], Any], call: Caller, prompt: str, added: Sequence[T.StructField],
    batch_rows: int, rate: tuple[float, int] | None = None, profile: ResourceProfile | None = None,
) -> DataFrame:
    carried = [f for f in df.schema.fields if f.name != prompt]
    names = [f.name for f in carried]
    kinds = [{T.StringType(): pa.string(), T.LongType(): pa.int64()}[f.dataType] for f in added]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plugin = limit = None
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                if plugin is None:
                    plugin = make()
                    plugin.open()
                    if rate is not None:
                        per_second, callers = rate
                        place = TaskContext.get().partitionId() % callers
                        limit = RateLimit(per_second / callers, lead=place / per_second)
                asked = batch.column(prompt).to_pylist()
                live = [i for i, p in enumerate(asked) if p is not None]
                rows: list[tuple] = [(None,) * (len(added) - 1) + ("missing prompt",)] * len(asked)
                if live:
                    for i, row in zip(live, _guarded(call, plugin, [asked[i] for i in live], len(added), limit)):
                        rows[i] = row
                columns = [batch.column(n) for n in names]
                columns += [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names + [f.name for f in added])
        if limit is not None:
            limit.finish()

    ship(df.sparkSession)
    return df.mapInArrow(answer, T.StructType([*carried, *added]), profile=profile)


def _spread(df: DataFrame, key: Sequence[str], workers: int | None) -> DataFrame:
    """As many tasks as concurrent callers, rows dealt by their unique key; as read when unbounded."""
    return df if workers is None else df.repartition(workers, *key)


def generate(
    df: DataFrame, make: Callable[[], Generator], key: Sequence[str], prompt: str = "prompt",
    out: str = "generated_solution", engine: str | None = None, workers: int | None = None,
    batch_rows: int = CALL_ROWS, stop: Sequence[str] = (), strip_echo: bool = False,
    profile: ResourceProfile | None = None, timed: bool = False,
) -> DataFrame:
    """Adds ``out, latency_us, first_token_us, error`` and drops the prompt; ``timed`` adds ``last_token_us, parts``.

    On a cluster ``profile`` says what one model needs, say a GPU, and so bounds how many run at a
    time; ``workers`` bounds it by the number of tasks. ``stop`` and ``strip_echo`` bring engines that echo the prompt or run past the end into the same
    form as those that do not.
    """
    source = df.withColumn("_prompt", F.col(prompt)) if strip_echo else df
    added = [*(PART_FIELDS if timed else ()), *COMPLETION_FIELDS]
    answered = _run(_spread(source, key, workers), make, _completions(timed), prompt, added, batch_rows, None, profile)
    completion = F.col("completion")
    if strip_echo:
        completion = without_echo(completion, F.col("_prompt"))
    completion = cut_at_stop(completion, stop)
    result = answered.withColumn(out, completion).drop("completion", "_prompt")
    return result if engine is None else result.withColumn("engine", F.lit(engine))


def judge(
    df: DataFrame, make: Callable[[], Judge], key: Sequence[str], prompt: str = "prompt", workers: int = 25,
    batch_rows: int = 20, calls_per_second: float | None = None, profile: ResourceProfile | None = None,
    task_rows: int = TASK_ROWS, sent: bool = False,
) -> DataFrame:
    """Adds ``raw, error`` and drops the prompt; ``sent`` adds ``sent_us``, when each call was sent.

    At most ``workers`` callers share the allowed rate evenly. Each sends one prompt at a time, spaced by its share; the first calls of
    tasks that start together are spaced too, and a task waits out its last space, so a rate holds over any number of tasks. Without a
    ``profile`` there are as many tasks as callers. With one that lets ``workers`` tasks run at a time, tasks are cut by
    ``task_rows``, which has the rows counted.
    """
    rate = None if calls_per_second is None else (calls_per_second, workers)
    tasks = workers if profile is None else workers * max(1, -(-df.count() // (workers * task_rows)))
    added = [*([SENT_FIELD] if sent else ()), *JUDGEMENT_FIELDS]
    return _run(_spread(df, key, tasks), make, _judgements(sent), prompt, added, batch_rows, rate, profile)


def rounds_for(rows: int, workers: int, task_rows: int = TASK_ROWS) -> int:
    """Rounds in which ``workers`` tasks of about ``task_rows`` rows answer all rows."""
    return max(1, -(-rows // (workers * task_rows)))


def _finished(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def in_rounds(df: DataFrame, key: Sequence[str], rounds: int, step: Step, folder: str) -> DataFrame:
    """Apply a calling ``step`` to ``rounds`` slices of the table in turn, each stored before the next.

    A slice is a hash class of the unique key, so slices are alike in size. Started again on the same
    ``folder``, finished slices are kept and only the others are called for.
    """
    return with_attempts(df, key, rounds, lambda attempt: step, folder)


def with_attempts(
    df: DataFrame, key: Sequence[str], rounds: int, step_of: Callable[[int], Step], folder: str, attempts: int = 1
) -> DataFrame:
    """:func:`in_rounds`, after which rows with an ``error`` are called again, up to ``attempts`` times in all.

    ``step_of`` gives the calling step of an attempt, counted from 1. The ledger below ``folder`` holds what is asked, and per attempt the
    answers slice by slice. An attempt calls the rows that the one before left with an error and no others, so a row is claimed by
    its key and attempt: a slice that is stored is never called again, one cut short is. The answer of a row is that of
    its last attempt; started again with more attempts, the ledger goes on from there.
    """
    spark = df.sparkSession
    asked = f"{folder}/asked"
    if not _finished(spark, asked):
        sliced = df.withColumn("call_slice", F.pmod(F.xxhash64(*key), F.lit(rounds)).cast("int"))
        sliced.write.mode("overwrite").partitionBy("call_slice").parquet(asked)
    slice_field = T.StructField("call_slice", T.IntegerType())
    stored = spark.read.schema(T.StructType([*df.schema.fields, slice_field])).parquet(asked)
    settled: list[DataFrame] = []
    for attempt in range(1, attempts + 1):
        step = step_of(attempt)
        place = f"{folder}/answers" if attempt == 1 else f"{folder}/answers-{attempt}"
        for number in range(rounds):
            answers = f"{place}/call_slice={number}"
            if not _finished(spark, answers):
                part = stored.filter(F.col("call_slice") == number).drop("call_slice")
                step(part).write.mode("overwrite").parquet(answers)
        schema = T.StructType([*step(stored.drop("call_slice")).schema.fields, slice_field])
        answered = spark.read.schema(schema).parquet(place)
        failed = answered.filter(F.col("error").isNotNull()) if "error" in answered.columns and attempt < attempts else None
        if failed is None or failed.isEmpty():
            return _together([*settled, answered.drop("call_slice")])
        settled.append(answered.filter(F.col("error").isNull()).drop("call_slice"))
        # Failed rows are asked again in the slice they are in.
        stored = stored.join(failed.select(*key, "call_slice"), [*key, "call_slice"], "left_semi")
    return _together(settled)


def _together(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def cap_tokens(ids: str, limit: int = fixed.MAX_NEW_TOKENS):
    """The first ``limit`` generated ids."""
    return F.slice(F.col(ids), 1, limit)
