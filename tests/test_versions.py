"""Versions are made once, and the log shows every append whole or not at all."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tabloom.sources import experiment_log, versions


def test_a_number_is_given_once(spark, tmp_path):
    folder = str(tmp_path / "v")
    with ThreadPoolExecutor(8) as writers:
        given = list(writers.map(lambda i: (versions.commit(spark, folder, {"i": i}), i), range(40)))
    assert sorted(n for n, _ in given) == list(range(40)) == versions.numbers(spark, folder)
    assert {n: versions.entry_of(spark, folder, n)["i"] for n, _ in given} == dict(given)
    assert not versions.make_once(spark, versions.version_file(folder, 3), "{}")
    assert versions.numbers(spark, str(tmp_path / "none")) == []


def test_a_lost_writer_leaves_an_unused_number(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.createDataFrame([(1, "r")], "k long, raw string")
    (tmp_path / "log" / "versions").mkdir(parents=True)
    (tmp_path / "log" / "versions" / f"{0:020d}.json").write_text("")
    (tmp_path / "log" / "versions" / f"{1:020d}.json").write_text('{"append_id": "x", "experi')
    assert experiment_log.read_experiments(spark, log).count() == 0
    experiment_log.append_experiment(rows, log, "e", "a", "f", "t")
    assert versions.numbers(spark, f"{log}/versions") == [0, 1, 2] and versions.entry_of(spark, f"{log}/versions", 1) is None
    assert [r["experiment_id"] for r in experiment_log.read_experiments(spark, log).collect()] == ["e"]


def test_readers_see_appends_whole(spark, tmp_path):
    """While an experiment is written again and again, a reader finds as many responses as its header says."""
    log = str(tmp_path / "log")
    rows = spark.range(0, 40, 1, 4).selectExpr("id AS k", "concat('r', id) AS raw")
    experiment_log.append_experiment(rows, log, "e", "a", "f", "t")

    def write(step: int) -> None:
        experiment_log.append_experiment(rows.filter(F.col("k") < 10 + step), log, "e", "a", "f", f"t{step}")

    with ThreadPoolExecutor(2) as writers:
        writing = [writers.submit(write, step) for step in range(6)]
        sizes = []
        while not all(w.done() for w in writing):
            sizes.append(experiment_log.read_comparisons(spark, log, rows.select("k").schema).count())
        [w.result() for w in writing]
    assert set(sizes) <= {40, *range(10, 16)}
    last = experiment_log.read_experiments(spark, log).collect()
    assert len(last) == 1 and experiment_log.read_comparisons(spark, log, rows.select("k").schema).count() == last[0]["total_comparisons"]


def test_experiments_of_a_run_in_one_version(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, "abc"[i % 3], f"r{i}") for i in range(9)], "k long, evaluation_type string, raw string")
    experiment_log.append_experiments(rows, log, {"a": ("r1-a", "f/a"), "b": ("r1-b", "f/b"), "d": ("r1-d", "f/d")}, "t")
    assert versions.numbers(spark, f"{log}/versions") == [0]
    found = {r["experiment_id"]: r["total_comparisons"] for r in experiment_log.read_experiments(spark, log).collect()}
    assert found == {"r1-a": 3, "r1-b": 3, "r1-d": 0}
    assert {r["raw"] for r in experiment_log.read_comparisons(spark, log, rows.select("k").schema).collect()} == {"r0", "r3", "r6", "r1", "r4", "r7"}
