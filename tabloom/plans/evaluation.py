"""Generation over a test table, and judging one engine against the base model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import EvaluationSettings
from tabloom.functions import chat, prompts
from tabloom.functions.tokens import first_tokens
from tabloom.operators import calls
from tabloom.operators.plugins import Generator, Judge
from tabloom.operators.selection import split_too_long
from tabloom.operators.summaries import score_summary, with_scores
from tabloom.session import materialize, work_path
from tabloom.sources.experiment_log import append_experiment
from tabloom.sources.results import read_results

MakeGenerator = Callable[[], Generator]
MakeJudge = Callable[[], Judge]


def chat_prompts(df: DataFrame, problem: str = "Problem", system_message: str | None = None) -> DataFrame:
    turns = chat.inference_turns(F.col(problem), system_message)
    return df.withColumn("prompt", chat.render(turns, generation=True))


def plain_prompts(df: DataFrame, problem: str = "Problem", system_message: str | None = None) -> DataFrame:
    return df.withColumn("prompt", prompts.plain_problem_prompt(F.col(problem), system_message))


def generate_results(
    problems: DataFrame, make: MakeGenerator, key: Sequence[str], engine: str, plain: bool = False,
    settings: EvaluationSettings = EvaluationSettings(), strip_echo: bool = False, max_new_tokens: int | None = None,
    max_model_len: int | None = None,
) -> DataFrame:
    """``key, problem, original_solution, generated_solution`` and call measurements of one engine.

    A prompt above ``max_model_len`` words and signs is not sent; its row says so in ``error``. An answer ends
    with its ``max_new_tokens``-th word or sign.
    """
    render = plain_prompts if plain else chat_prompts
    renamed = problems.select(*key, F.col("Problem").alias("problem"), F.col("Solution").alias("original_solution"))
    asked = render(renamed, "problem", settings.system_message)
    long = None
    if max_model_len is not None:
        asked, long = split_too_long(asked, "prompt", max_model_len)
    answered = calls.generate(
        asked, make, key, engine=engine, workers=settings.cpu_workers, stop=settings.stop, strip_echo=strip_echo,
        batch_rows=settings.cpu_batch_size or calls.CALL_ROWS,
    )
    if max_new_tokens is not None:
        answered = answered.withColumn("generated_solution", first_tokens(F.col("generated_solution"), max_new_tokens))
    if long is None:
        return answered
    aside = long.drop("prompt", "tokens").withColumns({"error": F.lit("prompt too long"), "engine": F.lit(engine)})
    return answered.unionByName(aside, allowMissingColumns=True)


def with_base_outputs(
    results: DataFrame, make: MakeGenerator, key: Sequence[str], settings: EvaluationSettings = EvaluationSettings()
) -> DataFrame:
    """Adds ``base_solution`` to each result row.

    The base model answers in the same pass that carries the tuned output along, so the two are
    paired without a join.
    """
    kept = results.select(*key, "problem", "generated_solution")
    asked = chat_prompts(kept, "problem", settings.system_message)
    answered = calls.generate(
        asked, make, key, out="base_solution", workers=settings.cpu_workers, stop=settings.stop,
        batch_rows=settings.cpu_batch_size or calls.CALL_ROWS,
    )
    return answered.select(*kept.columns, "base_solution", F.col("error").alias("base_error"))


def judged(
    paired: DataFrame, make: MakeJudge, key: Sequence[str], settings: EvaluationSettings = EvaluationSettings()
) -> DataFrame:
    """Adds the judge's ``raw`` response, or its ``error``, to each pair; the tuned text is shown first."""
    prompt = prompts.judge_prompt(F.col("problem"), F.col("generated_solution"), F.col("base_solution"))
    return calls.judge(
        paired.withColumn("prompt", prompt), make, key, workers=settings.io_workers,
        batch_rows=settings.judge_batch, calls_per_second=settings.calls_per_second,
    )


@dataclass(frozen=True)
class Evaluation:
    base_outputs: DataFrame
    comparisons: DataFrame

    def summary(self, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
        return score_summary(with_scores(self.comparisons, strict=strict), by)


def stored_calls(
    df: DataFrame, key: Sequence[str], settings: EvaluationSettings, step: Callable[[DataFrame], DataFrame], label: str,
    folder: str | None = None,
) -> DataFrame:
    """Run a calling step once and keep its answers, in rounds and attempts when there are several.

    Without a number of rounds, a round is what the judge's callers answer in one task each.
    """
    rounds = settings.rounds
    if rounds is None:
        rounds = calls.rounds_for(df.count(), settings.io_workers)
    if rounds <= 1 and settings.attempts <= 1 and folder is None:
        return materialize(step(df), label)
    place = f"{folder}/{label}" if folder else work_path(df.sparkSession, label)
    return calls.with_attempts(df, key, rounds, lambda attempt: step, place, settings.attempts)


def evaluate(
    results: DataFrame, make_base: MakeGenerator, make_judge: MakeJudge | None, key: Sequence[str],
    settings: EvaluationSettings = EvaluationSettings(), stored: bool = True, folder: str | None = None,
) -> Evaluation:
    """Base outputs and judged comparisons of results; without a judge the comparisons are empty.

    Calls are stored before they are read twice, below ``folder`` if the evaluation should be
    resumable. With ``stored=False`` the caller promises to read the result once.
    """

    def answered(rows: DataFrame) -> DataFrame:
        return with_base_outputs(rows, make_base, key, settings)

    def scored(rows: DataFrame) -> DataFrame:
        return judged(rows, make_judge, key, settings)

    if stored:
        paired = stored_calls(results, key, settings, answered, "base_outputs", folder)
    else:
        paired = answered(results)
    carried = paired.select(*key, "problem", "generated_solution", "base_solution")
    if make_judge is None:
        nothing = [F.lit(None).cast("string").alias(n) for n in ("raw", "error")]
        return Evaluation(paired, carried.filter(F.lit(False)).select("*", *nothing))
    if stored:
        return Evaluation(paired, stored_calls(carried, key, settings, scored, "comparisons", folder))
    return Evaluation(paired, scored(carried))


def evaluate_file(
    spark: SparkSession, path: str, engine: str, key: T.StructType, make_base: MakeGenerator, make_judge: MakeJudge,
    settings: EvaluationSettings = EvaluationSettings(), multi_line: bool = False, folder: str | None = None,
) -> DataFrame:
    """The one-row summary of one engine's results, as written to files with their keys."""
    results = read_results(spark, path, multi_line, key).filter(F.col("engine") == engine)
    return evaluate(results, make_base, make_judge, key.fieldNames(), settings, folder=folder).summary()


def evaluate_and_log(
    results: DataFrame, make_base: MakeGenerator, make_judge: MakeJudge | None, key: Sequence[str], log: str,
    experiment_id: str, evaluation_type: str, inference_output_file: str, timestamp: str,
    settings: EvaluationSettings = EvaluationSettings(), folder: str | None = None,
) -> DataFrame:
    """Judge one engine's results, add the responses to the log and return the one-row summary."""
    done = evaluate(results, make_base, make_judge, key, settings, folder=folder)
    append_experiment(
        done.comparisons.select(*key, "raw"), log, experiment_id, evaluation_type, inference_output_file, timestamp
    )
    return done.summary()
