"""Files in and out."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tabloom.operators.summaries import total_megabytes
from tabloom.schemas import BASE_OUTPUT_FILE, GENERATION_FILE
from tabloom.sources import experiment_log, files, problems, results, runs, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


CSV = 'id,Solution,Problem\n1,"s ""hi""","line one\nline \\frac{1}{2}, two"\n2,,q\n3,x,NA\n4,"",y\n5," NA ",None \n'


def test_problems_csv(spark, tmp_path):
    path = write(tmp_path / "p.csv", CSV)
    rows = [tuple(r) for r in problems.read_problems(spark, path).collect()]
    assert rows == [
        ("line one\nline \\frac{1}{2}, two", 's "hi"'), ("q", None), (None, "x"), ("y", None), ("None ", " NA "),
    ]
    replaced = [tuple(r) for r in problems.read_problems(spark, path, null_as="nan").collect()]
    assert replaced[1:4] == [("q", "nan"), ("nan", "x"), ("y", "nan")]


def test_missing_file_and_column(spark, tmp_path):
    with pytest.raises(AnalysisException) as missing:
        problems.read_problems(spark, str(tmp_path / "none.csv"))
    assert missing.value.getCondition() == "PATH_NOT_FOUND"
    with pytest.raises(AnalysisException):
        problems.read_problems(spark, write(tmp_path / "q.csv", "Problem\nx\n"))


def test_ingest_sets_incomplete_rows_aside(spark, tmp_path):
    whole, incomplete = problems.ingest_problems(spark, write(tmp_path / "p.csv", CSV), str(tmp_path / "out"))
    assert sorted(r["Problem"] for r in whole.collect()) == ["None ", "line one\nline \\frac{1}{2}, two"]
    assert incomplete.count() == 3
    ids = {r["example_id"] for r in whole.unionByName(incomplete).collect()}
    assert len(ids) == 5
    assert {r["example_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == ids


def test_result_files(spark, tmp_path):
    rows = [{"problem": f"p{i}", "original_solution": "o", "generated_solution": f"g\n{i}"} for i in range(5)]
    for name, indent in (("flat.json", None), ("indented.json", 2)):
        path = write(tmp_path / name, json.dumps(rows, indent=indent))
        read = results.read_results(spark, path)
        assert [r.asDict() for r in read.collect()] == rows
        placed = results.with_list_position(spark, path, GENERATION_FILE)
        assert {r["position"]: r["problem"] for r in placed.collect()} == {i: f"p{i}" for i in range(5)}
    old = write(tmp_path / "old.json", json.dumps([{"problem": "p", "original_solution": "o", "solution": "s"}]))
    assert results.read_results(spark, old).first()["generated_solution"] == "s"


def test_positional_pairing(spark, tmp_path):
    tuned = write(tmp_path / "t.json", json.dumps([{"problem": "same", "generated_solution": f"t{i}"} for i in range(4)]))
    base = write(tmp_path / "b.json", json.dumps([{"problem": "same", "solution": f"b{i}"} for i in range(4)]))
    left = results.with_list_position(spark, tuned, GENERATION_FILE).select("position", "generated_solution")
    right = results.with_list_position(spark, base, BASE_OUTPUT_FILE).select("position", "solution")
    pairs = left.join(right, "position").collect()
    assert {(r["generated_solution"], r["solution"]) for r in pairs} == {(f"t{i}", f"b{i}") for i in range(4)}
    assert results.read_base_outputs(spark, base).count() == 4


def test_results_are_overwritten_per_engine(spark, tmp_path):
    path = str(tmp_path / "results")

    def frame(engine, text):
        return spark.createDataFrame([("p", "o", text, engine)], "problem string, original_solution string, generated_solution string, engine string")

    results.write_results(frame("a", "1"), path)
    results.write_results(frame("b", "2"), path)
    results.write_results(frame("a", "3"), path)
    stored = spark.read.parquet(path).collect()
    assert {(r["engine"], r["generated_solution"]) for r in stored} == {("a", "3"), ("b", "2")}


def test_comparisons_keep_raw_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a"'), (2, None)], "k long, raw string")
    results.write_comparisons(rows, str(tmp_path / "c"))
    assert {(r["k"], r["raw"]) for r in spark.read.schema("k long, raw string").json(str(tmp_path / "c")).collect()} == {(1, '{"a"'), (2, None)}


OLD = {"timestamp": "2024-01-01 00:00:00", "comparisons": ["x", None], "metadata": {"evaluation_type": "a", "total_comparisons": 2}}


def test_log_documents_of_both_layouts(spark, tmp_path):
    write(tmp_path / "old.json", json.dumps(OLD, indent=2))
    write(tmp_path / "new.json", json.dumps({"experiments": [OLD, {**OLD, "comparisons": []}]}))
    write(tmp_path / "broken.json", '{"experiments": [')
    experiments, broken = experiment_log.read_log_documents(spark, str(tmp_path))
    found = sorted((r["file"], r["comparisons"], r["metadata"]["total_comparisons"]) for r in experiments.collect())
    assert found == [("new.json", [], 2), ("new.json", ["x", None], 2), ("old.json", ["x", None], 2)]
    assert [r["file"] for r in broken.collect()] == ["broken.json"]


def test_missing_log_is_empty(spark, tmp_path):
    experiments, broken = experiment_log.read_log_documents(spark, str(tmp_path / "none"))
    assert experiments.count() == 0 and broken.count() == 0
    assert experiment_log.read_experiments(spark, str(tmp_path / "none")).count() == 0


def test_log_appends_and_repeats(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "k long, raw string")
    experiment_log.append_experiment(rows, log, "e1", "a", "f", "2024-01-01 00:00:00")
    experiment_log.append_experiment(rows.limit(2), log, "e2", "b", "f", "2024-01-02 00:00:00")
    experiment_log.append_experiment(rows.filter("k < 3"), log, "e1", "a", "f", "2024-01-03 00:00:00")
    experiment_log.append_experiment(rows.limit(0), log, "e3", "b", "f", "2024-01-03 00:00:00")
    entries = {r["experiment_id"]: (r["timestamp"], r["total_comparisons"]) for r in experiment_log.read_experiments(spark, log).collect()}
    assert entries == {"e1": ("2024-01-03 00:00:00", 3), "e2": ("2024-01-02 00:00:00", 2), "e3": ("2024-01-03 00:00:00", 0)}
    stored = experiment_log.read_comparisons(spark, log, rows.select("k").schema).groupBy("experiment_id").count().collect()
    assert {r["experiment_id"]: r["count"] for r in stored} == {"e1": 3, "e2": 2}
    experiment_log.append_experiment(rows.limit(0), log, "e1", "a", "f", "t")
    experiment_log.append_experiment(rows, log, "2024-01-01 10:00/é=%", "a b", "f", "t")
    again = {r["experiment_id"]: r["total_comparisons"] for r in experiment_log.read_experiments(spark, log).collect()}
    assert again == {"e1": 0, "e2": 2, "e3": 0, "2024-01-01 10:00/é=%": 5}
    stored = experiment_log.read_comparisons(spark, log, rows.select("k").schema)
    assert {(r["evaluation_type"], r["experiment_id"]) for r in stored.collect()} == {("b", "e2"), ("a b", "2024-01-01 10:00/é=%")}
    counted = experiment_log.experiment_count(experiment_log.read_experiments(spark, log)).collect()
    assert {r["evaluation_type"]: r["experiments"] for r in counted} == {"a": 1, "b": 2, "a b": 1}


def test_unfinished_append_is_invisible(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "r")], "k long, raw string")
    experiment_log.append_experiment(rows, log, "e1", "a", "f", "t")
    rows.withColumns({"evaluation_type": F.lit("a"), "experiment_id": F.lit("e9")}).write.mode("append").partitionBy(
        "evaluation_type", "experiment_id"
    ).parquet(f"{log}/comparisons")
    assert [r["experiment_id"] for r in experiment_log.read_comparisons(spark, log, rows.select("k").schema).collect()] == ["e1"]


def test_entries_are_bounded_parts_in_order(spark):
    rows = spark.createDataFrame([(i, "a", None if i == 3 else f"r{i}") for i in range(25)], "k long, evaluation_type string, raw string")
    made = experiment_log.entries(rows, ["k"], "t", "f", rows=10).collect()
    listed = sorted((r["comparisons"] for r in made), key=lambda c: int(c[0][1:]))
    assert [len(c) for c in listed] == [10, 10, 5] and listed[0][3] is None
    assert sum(listed, []) == [None if i == 3 else f"r{i}" for i in range(25)]
    assert {r["metadata"]["total_comparisons"] for r in made} == {25}
    assert sorted(r["metadata"]["part"] for r in made) == [0, 1, 2] and {r["metadata"]["experiment_id"] for r in made} == {"a"}
    stored = experiment_log.entries(rows, ["k"], "t", "f", rows=10).withColumn("file", F.lit("x"))
    assert [tuple(r) for r in experiment_log.assembled(stored).collect()] == [("a", "a", 25, 25)]


def test_file_sizes(spark, folder):
    row = total_megabytes(files.scan_files(spark, folder)).first()
    sizes = [os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names]
    assert row["files"] == len(sizes) and row["megabytes"] == sum(sizes) / 1048576


def test_file_contents_are_not_read(spark, folder):
    plan = files.scan_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_datasets(spark, tmp_path):
    path = str(tmp_path / "set")
    spark.range(50).withColumn("split", F.when(F.col("id") < 20, "test").otherwise("train")).write.partitionBy("split").parquet(path)
    frame = tables.scan_dataset(spark, path)
    assert sorted(r["id"] for r in tables.load_split(frame, ["id"], "train[:3]").collect()) == [20, 21, 22]
    assert tables.load_split(frame, ["id"], "test").count() == 20
    keyed = tables.with_file_key(spark, path)
    assert keyed.select("file", "row").distinct().count() == 50
    frame.createOrReplaceTempView("registered")
    assert tables.scan_dataset(spark, "registered").count() == 50


def test_literal_columns(spark):
    assert [tuple(r) for r in tables.from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}, "a int, b string").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        tables.from_columns(spark, {"a": [1], "b": []}, "a int, b string")


def test_run_records_accumulate(spark, tmp_path):
    for run in ("r1", "r2"):
        runs.write_run(spark.range(1).select(F.lit(run).alias("run_id")), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


@pytest.mark.parametrize("size, count", [(1 << 20, 1), (100, 10), (300, 4)])
def test_arrays_are_written_by_tasks_of_bounded_size(spark, tmp_path, size, count):
    rows = spark.createDataFrame([*((i, "é" * 50) for i in range(10)), (10, None)], "example_id long, text string")
    path = str(tmp_path / "array")
    dealt = results.in_files(rows, ["text"], size)
    assert dealt.rdd.getNumPartitions() == count
    results.write_json_array(dealt, path)
    read = results.read_json_array(spark, path, rows.schema).select("example_id", "text")
    assert sorted(read.collect()) == sorted(rows.collect())
