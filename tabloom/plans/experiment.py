"""A whole experiment: several engines over one test table, judged, averaged, logged, recorded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.config import EvaluationSettings, TrainingSettings, as_text
from tabloom.operators.pairing import pair_outputs
from tabloom.operators.summaries import run_status, score_summary, with_scores
from tabloom.plans.evaluation import MakeGenerator, MakeJudge, generate_results, judged, stored_calls
from tabloom.sources import experiment_log
from tabloom.sources.results import write_results
from tabloom.sources.runs import write_run


@dataclass(frozen=True)
class Engine:
    """One way of running the tuned model.

    An engine that repeats the prompt in its answer sets ``strip_echo``. ``stop`` and ``system_message`` replace those
    of the settings. Prompts above ``max_model_len`` tokens are set aside with an error instead of being sent;
    answers are cut after ``max_new_tokens`` words and signs.
    """

    name: str
    make: MakeGenerator
    plain: bool = False
    strip_echo: bool = False
    stop: tuple[str, ...] | None = None
    system_message: str | None = None
    max_new_tokens: int | None = None
    max_model_len: int | None = None

    def settings(self, common: EvaluationSettings) -> EvaluationSettings:
        given = {"stop": self.stop, "system_message": self.system_message}
        return replace(common, **{name: value for name, value in given.items() if value is not None})


@dataclass(frozen=True)
class Experiment:
    run_id: str
    timestamp: str
    key: tuple[str, ...]
    engines: tuple[Engine, ...]
    make_base: MakeGenerator
    make_judge: MakeJudge
    training: TrainingSettings = TrainingSettings()
    settings: EvaluationSettings = EvaluationSettings()
    training_results: Mapping[str, str] = field(default_factory=dict)


def bag_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def generate_all(problems: DataFrame, experiment: Experiment, folder: str | None = None) -> DataFrame:
    """Results of every engine over the same problems, stored once, in rounds if the settings say so."""

    def stored(e: Engine) -> DataFrame:
        def step(rows: DataFrame) -> DataFrame:
            return generate_results(
                rows, e.make, experiment.key, e.name, e.plain, e.settings(experiment.settings), e.strip_echo,
                e.max_new_tokens, e.max_model_len,
            )

        return stored_calls(problems, experiment.key, experiment.settings, step, f"results-{e.name}", folder)

    return bag_union([stored(e) for e in experiment.engines])


def base_outputs(problems: DataFrame, experiment: Experiment, folder: str | None = None) -> DataFrame:
    """The base model's answers, stored once. Each problem is answered once, however many engines there are."""

    def step(rows: DataFrame) -> DataFrame:
        return generate_results(rows, experiment.make_base, experiment.key, "base", settings=experiment.settings)

    return stored_calls(problems, experiment.key, experiment.settings, step, "base_outputs", folder)


def compare_all(results: DataFrame, base: DataFrame, experiment: Experiment, folder: str | None = None) -> DataFrame:
    """Judged comparisons of every engine with the base answers, paired by key.

    Pairs in which either side has no answer are not sent to the judge.
    """
    key, pair_key = experiment.key, (*experiment.key, "engine")
    tuned = results.filter("error is null").select(*pair_key, "problem", "generated_solution")
    paired = pair_outputs(tuned, base.filter("error is null"), key, "generated_solution")

    def scored(rows: DataFrame) -> DataFrame:
        return judged(rows, experiment.make_judge, pair_key, experiment.settings)

    return stored_calls(paired, pair_key, experiment.settings, scored, "comparisons", folder)


def log_all(comparisons: DataFrame, experiment: Experiment, log: str, output: str) -> str:
    """One log entry per engine, all in one write; returns its folder."""
    rows = comparisons.select(*experiment.key, "raw", F.col("engine").alias("evaluation_type"))
    named = {e.name: (f"{experiment.run_id}-{e.name}", f"{output}/engine={e.name}") for e in experiment.engines}
    return experiment_log.append_experiments(rows, log, named, experiment.timestamp)


def step_status(results: DataFrame, base: DataFrame, comparisons: DataFrame) -> DataFrame:
    """``engine, step, rows, errors, ok`` of a run: a step is in order if it has a row without an error.

    Steps of an engine are its generation and its evaluation; the base model is a step of the engine ``base``.
    """
    frames = (("generation", results), ("generation", base), ("evaluation", comparisons))
    parts = [
        frame.groupBy("engine").agg(F.count("*").alias("rows"), F.count("error").alias("errors")).withColumn("step", F.lit(step))
        for step, frame in frames
    ]
    return bag_union(parts).withColumn("ok", F.col("errors") < F.col("rows"))


def run_record(
    summary: DataFrame, experiment: Experiment, compared: str | None = None, output: str | None = None, steps: DataFrame | None = None
) -> DataFrame:
    """One nested row describing the run: settings, scores per engine, files, status and errors.

    ``summary`` has one row per engine. A base model or a first engine with a step that has nothing but errors, or no
    judged row, fails the run; a later engine makes it a partial success. ``steps`` come from :func:`step_status`;
    without them only the judged rows count. ``compared`` is the folder that holds the run's comparisons.
    """
    t = experiment.training

    def scores(name: str) -> Column:
        row = F.when(
            F.col("engine") == name,
            F.struct(
                F.col("finetuned_avg").alias("finetuned_avg_score"), F.col("base_avg").alias("base_avg_score"),
                F.col("total_comparisons"),
            ),
        )
        return F.max(row).alias(f"{name}_results")

    def judged_rows(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("engine") == name, F.col("all_comparisons"))), F.lit(0))

    first, *others = [e.name for e in experiment.engines]
    later = [judged_rows(n) == 0 for n in others]
    status = F.when(judged_rows(first) == 0, "failed")
    if later:
        status = status.when(reduce(lambda a, b: a | b, later), "partial_success")
    names = [e.name for e in experiment.engines]
    gathered = summary.agg(status.otherwise("success").alias("_judged"), *[scores(n) for n in names])
    if steps is None:
        gathered = gathered.withColumns({"status": F.col("_judged"), "errors": F.lit(0).cast("long")})
    else:
        step = F.when(F.col("engine").isin(others), "later").otherwise("first")
        told = run_status(steps.withColumn("_part", step).withColumn("_run", F.lit(0)), ["_run"], "_part", "ok", ["later"])
        errors = steps.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
        worst = F.when((F.col("_told") == "failed") | (F.col("_judged") == "failed"), "failed").when(
            (F.col("_told") == "partial_success") | (F.col("_judged") == "partial_success"), "partial_success").otherwise("success")
        one = lambda d: d.withColumn("_one", F.lit(0))
        both = one(gathered).join(one(told.select(F.col("status").alias("_told"))), "_one", "left").join(one(errors), "_one")
        gathered = both.withColumn("_told", F.coalesce("_told", F.lit("success"))).withColumn("status", worst)

    def files(folder: str | None, column: str) -> Column:
        where = [F.lit(None if folder is None else f"{folder}/{column}={n}").cast("string").alias(n) for n in names]
        return F.struct(*where)

    settings = {f"training.{k}": v for k, v in as_text(t).items()}
    settings |= {f"evaluation.{k}": v for k, v in as_text(experiment.settings).items()}
    results = experiment.training_results
    return gathered.select(
        F.lit(experiment.run_id).alias("run_id"), F.lit(experiment.timestamp).alias("timestamp"), "status", "errors",
        F.struct(
            F.lit(t.lora_r).alias("r"), F.lit(t.lora_alpha).alias("lora_alpha"),
            F.lit(float(t.lora_dropout)).alias("lora_dropout"),
            F.array(*[F.lit(m) for m in t.target_modules]).alias("target_modules"),
        ).alias("lora_config"),
        F.struct(
            F.lit(t.optimizer).alias("optimizer"), F.lit(t.learning_rate).alias("learning_rate"),
            F.lit(t.batch_size).alias("batch_size"), F.lit(t.num_epochs).alias("epochs"),
        ).alias("training_config"),
        F.struct(
            F.lit(results.get("training_time", "N/A")).alias("training_time"),
            F.lit(results.get("peak_memory", "N/A")).alias("peak_memory"),
        ).alias("training_results"),
        *[f"{n}_results" for n in names],
        files(output, "engine").alias("inference_outputs"),
        files(compared, "evaluation_type").alias("comparison_scores"),
        F.create_map(*[F.lit(x) for pair in settings.items() for x in pair]).alias("settings"),
    )


def run_experiment(
    problems: DataFrame, experiment: Experiment, output: str | None = None, log: str | None = None, runs: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Generate, judge and average; optionally write all outputs, the log and the record. Returns the record.

    Answers are kept below ``folder``: started again with the same one, finished slices of generation, base model
    and judge are read and not called for.
    """
    results, base = generate_all(problems, experiment, folder), base_outputs(problems, experiment, folder)
    if output is not None:
        write_results(bag_union([results, base]), output)
    comparisons = compare_all(results, base, experiment, folder)
    compared = None if log is None else log_all(comparisons, experiment, log, output or "")
    summary = score_summary(with_scores(comparisons), ["engine"])
    record = run_record(summary, experiment, compared, output, step_status(results, base, comparisons))
    if runs is not None:
        write_run(record, runs)
    return record
