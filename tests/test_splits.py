"""Files read in many tasks against the same files read whole."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest

from tabloom.schemas import EXPERIMENT
from tabloom.sources import experiment_log, problems, results, splits

PARTS = ["a", "b", '"', ",", "\n", "}", "{", "[", "]", "\\", "é", "\U0001f600", "\r\n", "x y", "NA", ""]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def hostile(seed: int, count: int) -> list[tuple[str, str]]:
    pick = random.Random(seed)
    text = lambda: "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 12)))
    rows = [(text(), f"{i}{text()}") for i in range(count)]
    rows[count // 2] = ('long "\n' * 600, "} ] { [ " * 300)  # across several splits
    return rows


def write_csv(path, rows, end="\n"):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end)
        writer.writerow(problems.COLUMNS)
        writer.writerows(rows)
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records(spark, small_splits, tmp_path, end):
    rows = hostile(1, 150)
    path = write_csv(tmp_path / "a.csv", rows, end)
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    got = splits.records(spark, path, splits.CSV).collect()
    by_place = {r["position"]: next(csv.reader(io.StringIO(r["text"], newline=""))) for r in got}
    assert len(got) == len(by_place) == 151 and [by_place[i] for i in range(151)] == [list(problems.COLUMNS), *map(list, rows)]


def test_csv_equals_the_reader_of_whole_files(spark, small_splits, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in range(3):
        write_csv(folder / f"{name}.csv", hostile(name, 60))
    (folder / "blank.csv").write_text("Problem,Solution\n\nx,\n\n,\"\"\n\ny,z")
    split = problems.read_problems_split(spark, str(folder))
    assert split.dropDuplicates(["file", "position"]).count() == split.count() == 183
    whole = problems.read_problems(spark, str(folder))
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert text(split.select(*problems.COLUMNS)) == text(whole)


def test_ingest_split(spark, small_splits, tmp_path):
    path = write_csv(tmp_path / "a.csv", [("1", "x"), ("2", "NA"), ("3", "y\nz")])
    whole, incomplete = problems.ingest_problems(spark, path, str(tmp_path / "out"), split=True)
    assert {r["Problem"] for r in whole.collect()} == {"1", "3"} and [r["Problem"] for r in incomplete.collect()] == ["2"]


def test_open_quote_at_the_end(spark, small_splits, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Problem,Solution\n1,x\n2,\"open\nto the end\n")
    got = {r["position"]: r["text"] for r in splits.records(spark, str(path), splits.CSV).collect()}
    assert got == {0: "Problem,Solution", 1: "1,x", 2: '2,"open\nto the end'}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array(spark, small_splits, tmp_path, indent):
    rows = hostile(2, 120)
    listed = [{"problem": p, "original_solution": s, "generated_solution": "g", "deep": [{"x": [p, {}]}]} for p, s in rows]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(listed, indent=indent, ensure_ascii=False))
    schema = results.GENERATION_FILE
    got = sorted(results.read_json_array(spark, str(path), schema).drop("file").collect())
    assert [tuple(r)[:4] for r in got] == [(i, p, s, "g") for i, (p, s) in enumerate(rows)]
    whole = results.with_list_position(spark, str(path), schema).select("position", *schema.fieldNames())
    assert sorted(map(str, whole.collect())) == sorted(map(str, got))


@pytest.mark.parametrize("text", ["[]", "", "[\n]\n", '["a", 1, null, "{}"]'])
def test_json_array_without_objects(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    assert splits.records(spark, str(path), splits.json_elements()).count() == 0


def test_json_array_cut_off(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('["x", {"problem": "1"}, {"problem": "2}')
    got = splits.records(spark, str(path), splits.json_elements()).collect()
    assert [r["text"] for r in got if r["position"] == 0] == ['{"problem": "1"}']
    rows = results.read_json_array(spark, str(path), results.GENERATION_FILE).filter("problem is not null").collect()
    assert [r["problem"] for r in rows] == ["1"]


@pytest.mark.parametrize("indent", [None, 4])
def test_log_document(spark, small_splits, tmp_path, indent):
    entries = [
        {"timestamp": f"t{i}", "comparisons": [s, p], "metadata": {"evaluation_type": "e", "total_comparisons": i}}
        for i, (p, s) in enumerate(hostile(3, 60))
    ]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text(json.dumps({"version": {"x": [1]}, "experiments": entries}, indent=indent))
    (tmp_path / "log" / "old.json").write_text(json.dumps(entries[0]))
    got = experiment_log.read_log_arrays(spark, str(tmp_path / "log")).orderBy("position").collect()
    assert [r["comparisons"] for r in got] == [e["comparisons"] for e in entries]
    assert [r["metadata"]["total_comparisons"] for r in got] == list(range(60)) and set(EXPERIMENT.fieldNames()) <= set(got[0].asDict())


def test_written_arrays_are_arrays(spark, tmp_path):
    rows = spark.range(0, 50, 1, 4).selectExpr("id", "concat('\"}\n', id) AS text")
    results.write_json_array(rows.filter("id % 7 <> 0 OR id > 13"), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(files) == 4 and sum(len(json.loads(p.read_text())) for p in files) == 48
    again = results.read_json_array(spark, str(tmp_path / "out"), rows.schema)
    assert {r["text"] for r in again.collect()} == {f'"}}\n{i}' for i in range(50) if i % 7 or i > 13}
