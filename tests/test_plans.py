"""Whole flows."""

import os
import uuid
from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F

from tabloom.config import EvaluationSettings, TrainingSettings, as_text, resolve, resolved, unknown_keys
from tabloom.operators import pairing
from tabloom.operators.plugins import LeadingWords, WordCountJudge
from tabloom.operators.vocabulary import build_vocabulary
from tabloom.plans import evaluation, experiment, training
from tabloom.session import drop_work, materialize
from tabloom.sources import experiment_log
from tabloom.sources.results import in_input_order, read_results

KEY = ("example_id",)
TUNED, BASE = partial(LeadingWords, 4), partial(LeadingWords, 2)
ONE = EvaluationSettings(io_workers=2)


@pytest.fixture
def problems(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i)), f"s{i}") for i in range(1, 7)]
    return spark.createDataFrame(rows, "example_id long, Problem string, Solution string")


@pytest.fixture
def instructions(spark):
    rows = [(i, f"do {i}", "ctx" if i % 2 else "", f"out {i}") for i in range(5)]
    return spark.createDataFrame(rows, "example_id long, instruction string, input string, output string")


def test_dispatch_ignores_case_and_refuses_unknown_types(problems, instructions):
    assert training.training_texts(problems, "Math").columns[-1] == "text"
    assert training.training_texts(instructions, "ALPACA").filter(F.col("text").contains("### Input:\nctx")).count() == 2
    with pytest.raises(ValueError):
        training.training_texts(problems, "chat")


@pytest.mark.parametrize("kind", ["math", "alpaca"])
def test_prepare(problems, instructions, kind):
    frame = problems if kind == "math" else instructions
    known = build_vocabulary(training.training_texts(frame, kind))
    made = training.prepare(frame, known, kind, KEY, max_length=16)
    assert made.columns == ["example_id", "input_ids", "attention_mask"] + (["text"] if kind == "math" else [])
    rows = made.collect()
    assert len(rows) == frame.count() and all(len(r["input_ids"]) == len(r["attention_mask"]) == 16 for r in rows)


def test_calibration_rows_are_unpadded(instructions):
    known = build_vocabulary(training.training_texts(instructions, "alpaca"))
    rows = training.calibration_sample(instructions, known, KEY, rows=3).collect()
    assert sorted(r["example_id"] for r in rows) == [0, 1, 2]
    for r in rows:
        assert r["input_ids"][0] == 1 and r["input_ids"][-1] == 2 and set(r["attention_mask"]) == {1}
        assert len(r["input_ids"]) == len(r["attention_mask"]) and 0 not in r["input_ids"]


def test_training_batches(problems):
    texts = training.training_texts(problems, "math")
    rows = training.training_batches(texts, build_vocabulary(texts), KEY, TrainingSettings(num_epochs=2, max_length=32)).collect()
    assert len(rows) == 12 and {r["epoch"] for r in rows} == {0, 1}
    assert all(len(r["input_ids"]) == len(r["labels"]) == r["width"] == 32 for r in rows)


def expected(first, second, sizes=range(1, 7)):
    return tuple(sum(min(n, cap) for n in sizes) / len(sizes) for cap in (first, second))


@pytest.mark.parametrize("settings", [ONE, EvaluationSettings(io_workers=2, rounds=3, cpu_workers=2)])
def test_evaluate(problems, tmp_path, settings):
    results = evaluation.generate_results(problems, TUNED, KEY, "standard_inference")
    made = evaluation.evaluate(results, BASE, WordCountJudge, KEY, settings, folder=str(tmp_path / "e"))
    assert tuple(made.summary().first()) == (*expected(4, 2), 6, 6)
    assert made.base_outputs.count() == 6
    again = evaluation.evaluate(results, BASE, None, KEY, settings, folder=str(tmp_path / "e"))
    assert again.comparisons.count() == 0 and again.comparisons.columns == made.comparisons.columns


def test_without_a_judge_averages_are_zero(problems):
    results = evaluation.generate_results(problems, TUNED, KEY, "standard_inference")
    made = evaluation.evaluate(results, BASE, None, KEY)
    assert made.base_outputs.count() == 6 and tuple(made.summary().first()) == (0.0, 0.0, 0, 0)


def make_experiment(**changes):
    engines = (experiment.Engine("standard", TUNED), experiment.Engine("plain", partial(LeadingWords, 3), plain=True))
    return experiment.Experiment(**{
        "run_id": "r", "timestamp": "2024-01-01 00:00:00", "key": KEY, "engines": engines, "make_base": BASE,
        "make_judge": WordCountJudge, "settings": ONE, "training": TrainingSettings(lora_dropout=0.1), **changes,
    })


def test_experiment(spark, problems, tmp_path):
    output, log, record = (str(tmp_path / n) for n in ("results", "log", "runs"))
    row = experiment.run_experiment(problems, make_experiment(), output, log, record).first().asDict(True)
    assert row["status"] == "success" and row["lora_config"]["lora_dropout"] == 0.1
    for engine, cap in (("standard", 4), ("plain", 3)):
        found = row[f"{engine}_results"]
        assert (found["finetuned_avg_score"], found["base_avg_score"]) == expected(cap, 2) and found["total_comparisons"] == 6
    assert all(spark.read.parquet(row["comparison_scores"][n]).count() == 6 for n in ("standard", "plain"))
    assert all(spark.read.parquet(row["inference_outputs"][n]).count() == 6 for n in ("standard", "plain"))
    assert row["settings"]["evaluation.io_workers"] == "2" and row["settings"]["training.seed"] == "108"
    stored = spark.read.parquet(output).groupBy("engine").count().collect()
    assert {r["engine"]: r["count"] for r in stored} == {"standard": 6, "plain": 6, "base": 6}
    assert spark.read.json(record).first()["status"] == "success"
    logged = {r["experiment_id"]: r["total_comparisons"] for r in experiment_log.read_experiments(spark, log).collect()}
    assert logged == {"r-standard": 6, "r-plain": 6}


@pytest.mark.parametrize("engines, status", [([], "failed"), (["plain"], "failed"), (["standard"], "partial_success")])
def test_status_follows_the_judged_engines(spark, engines, status):
    rows = [(e, 1.0, 1.0, 1, 1) for e in engines]
    schema = "engine string, finetuned_avg double, base_avg double, total_comparisons long, all_comparisons long"
    row = experiment.run_record(spark.createDataFrame(rows, schema), make_experiment()).first()
    assert row["status"] == status and row["plain_results"] is None or engines == ["plain"]


def test_settings_precedence():
    made = resolve(EvaluationSettings, {"io_workers": 5, "rounds": 64}, rounds=32)
    assert (made.io_workers, made.rounds, made.cpu_workers) == (5, 32, None)
    assert [resolve(EvaluationSettings, {"io_workers": n}).judge_batch for n in (5, 100)] == [5, 20]
    assert resolve(EvaluationSettings, io_batch_size=7).judge_batch == 7
    with pytest.raises(KeyError):
        resolve(TrainingSettings, {"optim": "adamw_torch"})
    assert as_text(TrainingSettings())["seed"] == "108"


def test_settings_of_a_table_of_runs(spark):
    rows = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3"}), ({"z": "9"}, {})], "o map<string,string>, c map<string,string>")
    defaults = {"a": "d", "b": "e"}
    made = rows.select(resolved(F.col("o"), F.col("c"), defaults).alias("s"), unknown_keys(F.col("o"), defaults).alias("u"))
    assert [(r["s"], r["u"]) for r in made.collect()] == [({"a": "1", "b": "3"}, []), ({"a": "d", "b": "e"}, ["z"])]


def test_zipping_stops_at_the_shortest(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], [7, None]), (2, [], [1])], "k int, x array<string>, y array<int>")
    made = pairing.unzip_rows(rows, ["k"], ["x", "y"])
    assert sorted((r["k"], r["position"], r["x"], r["y"]) for r in made.collect()) == [(1, 0, "a", 7), (1, 1, "b", None)]


def test_chunked_left_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "k int, t int")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    made = pairing.chunked_left_join(left, right, "k", F.floor(F.col("t") / 8))
    assert sorted(tuple(r) for r in made.select("k", "t", F.coalesce("v", F.lit("-"))).collect()) == sorted(
        [(1, i, v) for i in range(50) for v in "xy"] + [(2, 0, "-")]
    )


def test_bag_union_keeps_duplicates(spark):
    assert experiment.bag_union([spark.range(2), spark.range(2)]).count() == 4


def test_json_lines_of_results(spark, tmp_path):
    spark.createDataFrame([("p", "g")], "problem string, generated_solution string").write.json(str(tmp_path / "r"))
    assert read_results(spark, str(tmp_path / "r"), multi_line=False).first()["generated_solution"] == "g"


def test_evaluate_and_log(spark, problems, tmp_path):
    log = str(tmp_path / "log")
    results = evaluation.generate_results(problems, TUNED, KEY, "standard_inference")
    made = evaluation.evaluate_and_log(results, BASE, WordCountJudge, KEY, log, "e1", "standard_inference", "f.json", "t", ONE)
    assert tuple(made.first()) == (*expected(4, 2), 6, 6)
    assert experiment_log.read_experiments(spark, log).first()["total_comparisons"] == 6


def test_training_source(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("Problem,Solution\na,b\n,c\n")
    made = training.training_source(spark, "math", str(csv), str(tmp_path / "work"))
    assert [(r["Problem"], r["Solution"]) for r in made.collect()] == [("a", "b")]
    spark.range(9).withColumn("split", F.lit("train")).write.parquet(str(tmp_path / "set"))
    made = training.training_source(spark, "alpaca", str(tmp_path / "set"), "", ["id"], "train[:4]")
    assert sorted(r["id"] for r in made.collect()) == [0, 1, 2, 3]


def test_presentation_order_and_cleaning_up(spark, problems):
    stored = materialize(problems, "kept")
    assert [r["example_id"] for r in in_input_order(stored, KEY).collect()] == [1, 2, 3, 4, 5, 6]
    assert stored.inputFiles()
    path = stored.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    drop_work(spark)
    assert not os.path.isdir(path)


def test_a_restarted_experiment_repeats_no_call(spark, problems, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counted(LeadingWords):
        def generate(self, prompts):
            for _ in prompts:
                (calls / uuid.uuid4().hex).touch()
            return super().generate(prompts)

    class BreaksOnce(WordCountJudge):
        def open(self):
            if not (calls / "broken").exists():
                (calls / "broken").touch()
                raise RuntimeError("the machine is gone")

    made = make_experiment()
    engines = tuple(replace(e, make=partial(Counted, 4)) for e in made.engines)
    run = replace(made, engines=engines, make_base=partial(Counted, 2), make_judge=BreaksOnce, settings=EvaluationSettings(io_workers=2, rounds=3))
    folder = str(tmp_path / "kept")
    with pytest.raises(Exception, match="the machine is gone"):
        experiment.run_experiment(problems, run, folder=folder).first()
    assert len(os.listdir(calls)) == 1 + 3 * problems.count()
    row = experiment.run_experiment(problems, run, folder=folder).first()
    assert len(os.listdir(calls)) == 1 + 3 * problems.count() and row["status"] == "success"
