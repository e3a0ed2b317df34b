"""The plug-in boundary: one model per task, failures as data, rates, resumable rounds."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tabloom.operators import calls
from tabloom.operators.plugins import (
    Completion, ConstantJudge, FailingAtFirst, Generator, Judge, LeadingWords, RateLimit, Streamed, TimedWords, WordCountJudge,
)
from tabloom.operators.summaries import latency_summary


def tracing(folder):
    """A generator that leaves a file for every open and every call."""

    class Tracing:
        def open(self):
            open(f"{folder}/open-{uuid.uuid4().hex}", "w").close()

        def generate(self, prompts):
            with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(prompts))
            if any("bad" in p for p in prompts):
                raise RuntimeError("no answer")
            return [Completion(p.upper(), 5) for p in prompts]

    return Tracing


def traces(folder, kind):
    return [f for f in os.listdir(folder) if f.startswith(kind)]


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, prompt string").withColumn("kept", F.array(F.col("k")))


def test_trial_plugins_follow_the_protocols():
    assert isinstance(LeadingWords(1), Generator) and isinstance(WordCountJudge(), Judge)


def test_one_model_per_task_and_small_batches(spark, tmp_path):
    made = calls.generate(
        prompts(spark, [f"p{i}" for i in range(20)]), tracing(tmp_path), ["k"], workers=3, batch_rows=4, engine="e"
    ).collect()
    assert {r["k"]: r["generated_solution"] for r in made} == {i: f"P{i}" for i in range(20)}
    assert all(r["kept"] == [r["k"]] and r["engine"] == "e" and r["error"] is None for r in made)
    assert all(r["latency_us"] >= 0 and r["first_token_us"] == 5 for r in made)
    assert len(traces(tmp_path, "open")) == 3 and len(traces(tmp_path, "call")) >= 5


def test_no_rows_load_no_model(spark, tmp_path):
    assert calls.generate(prompts(spark, ["a"]).filter("k < 0"), tracing(tmp_path), ["k"]).count() == 0
    assert traces(tmp_path, "open") == []


def test_a_bad_row_spoils_only_itself(spark, tmp_path):
    made = calls.generate(prompts(spark, ["a", "bad", None, "b"]), tracing(tmp_path), ["k"], workers=1).collect()
    rows = {r["k"]: (r["generated_solution"], r["error"]) for r in made}
    assert rows == {0: ("A", None), 1: (None, "RuntimeError: no answer"), 2: (None, "missing prompt"), 3: ("B", None)}


def test_wrong_number_of_answers_is_an_error(spark):
    class Silent:
        def open(self):
            pass

        def judge(self, prompts):
            return []

    row = calls.judge(prompts(spark, ["a"]), Silent, ["k"], workers=1).first()
    assert row["raw"] is None and row["error"].startswith("ValueError: 0 responses")


def test_echo_and_stop(spark):
    class Echo:
        def open(self):
            pass

        def generate(self, prompts):
            return [Completion(p + " answer</s>more") for p in prompts]

    made = calls.generate(prompts(spark, ["ask"]), Echo, ["k"], strip_echo=True, stop=["</s>"])
    assert made.columns == ["k", "kept", "latency_us", "first_token_us", "error", "generated_solution"]
    assert made.first()["generated_solution"] == " answer"


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 6))
        now[0] += seconds

    limit = RateLimit(2.0, clock=lambda: now[0], sleep=sleep)
    for _ in range(4):
        limit.wait()
    assert slept == [0.5, 0.5, 0.5]
    now[0] += 10
    limit.wait()
    limit.wait()
    assert slept == [0.5, 0.5, 0.5, 0.5]


def test_rate_is_shared_over_tasks(spark):
    class Fast:
        def open(self):
            pass

        def judge(self, prompts):
            return ["{}"] * len(prompts)

    made = calls.judge(prompts(spark, ["a"] * 6), Fast, ["k"], workers=2, calls_per_second=1000)
    assert made.count() == 6 and made.columns == ["k", "kept", "raw", "error"]


def test_rounds_resume(spark, tmp_path):
    traced, stored = tmp_path / "traces", str(tmp_path / "stored")
    traced.mkdir()
    frame = prompts(spark, [f"p{i}" for i in range(30)])
    make = tracing(traced)

    def step(rows):
        return calls.generate(rows, make, ["k"], workers=1)

    def broken(rows):
        if broken.left == 0:
            raise RuntimeError("lost")
        broken.left -= 1
        return step(rows)

    broken.left = 2
    with pytest.raises(RuntimeError):
        calls.in_rounds(frame, ["k"], 4, broken, stored)
    before = len(traces(traced, "open"))
    made = calls.in_rounds(frame, ["k"], 4, step, stored)
    assert {r["k"]: r["generated_solution"] for r in made.collect()} == {i: f"P{i}" for i in range(30)}
    assert before == 2 and len(traces(traced, "open")) == 4
    assert calls.in_rounds(frame, ["k"], 4, step, stored).count() == 30 and len(traces(traced, "open")) == 4


def test_failed_rows_are_called_again(spark, tmp_path):
    traced, stored = tmp_path / "traces", str(tmp_path / "stored")
    traced.mkdir()
    frame = prompts(spark, ["a" * (1 + i % 3) + f"{i:02}" for i in range(24)])  # a third answers in each attempt

    def step_of(attempt):
        class Noted(FailingAtFirst):
            def generate(self, asked):
                answers = super().generate(asked)
                with open(f"{traced}/call-{uuid.uuid4().hex}", "w") as out:
                    out.write("\n".join(f"{attempt}:{p}" for p in asked))
                return answers

        return lambda rows: calls.generate(rows, lambda: Noted(4, attempt), ["k"], workers=2, batch_rows=3)

    def answered(attempts):
        made = calls.with_attempts(frame, ["k"], 3, step_of, stored, attempts).collect()
        assert len(made) == 24 and len({r["k"] for r in made}) == 24
        return sum(r["error"] is None for r in made)

    assert [answered(n) for n in (1, 1, 2, 3, 3, 4)] == [8, 8, 16, 24, 24, 24]
    said = [line for f in traces(traced, "call") for line in (traced / f).read_text().split("\n")]
    assert len(said) == len(set(said)) == 24  # nothing that has an answer was called again


def test_an_attempt_cut_short_goes_on(spark, tmp_path):
    stored, frame = str(tmp_path / "stored"), prompts(spark, ["p" * (i % 3 + 1) for i in range(12)])

    def step_of(attempt):
        def step(rows):
            if attempt == 2 and step_of.broken:
                raise RuntimeError("lost")
            return calls.generate(rows, lambda: FailingAtFirst(4, attempt), ["k"], workers=1)

        return step

    step_of.broken = True
    with pytest.raises(RuntimeError):
        calls.with_attempts(frame, ["k"], 2, step_of, stored, 3)
    step_of.broken = False
    made = calls.with_attempts(frame, ["k"], 2, step_of, stored, 3).collect()
    assert len(made) == 12 and all(r["error"] is None for r in made)


def test_calls_keep_their_distance(spark):
    frame = prompts(spark, ["a"] * 60)
    made = calls.judge(frame, ConstantJudge, ["k"], workers=3, calls_per_second=100, sent=True).collect()
    sent = sorted(r["sent_us"] for r in made)
    assert len(sent) == 60 and all(r["error"] is None for r in made)
    for first in range(len(sent)):  # in any fifth of a second, the rate and one call a task
        assert sum(sent[first] <= t < sent[first] + 200_000 for t in sent) <= 20 + 3 + 1


def test_a_limit_leads_and_finishes():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 6))
        now[0] += seconds

    limit = RateLimit(2.0, clock=lambda: now[0], sleep=sleep, lead=0.25)
    limit.wait()
    limit.wait()
    limit.finish()
    limit.finish()
    assert slept == [0.25, 0.5, 0.5]


def test_rounds_by_size():
    assert [calls.rounds_for(n, 25, 10) for n in (0, 1, 250, 251, 100_000)] == [1, 1, 1, 2, 400]


def test_streamed_parts(spark):
    rows = prompts(spark, ["one three", "seventeen", ""])
    made = calls.generate(rows, lambda: Streamed(lambda: TimedWords(9)), ["k"], workers=1, timed=True)
    got = {r["k"]: (r["generated_solution"], r["first_token_us"], r["last_token_us"], r["parts"]) for r in made.collect()}
    assert got == {0: ("one three", 1030, 1080, 2), 1: ("seventeen", 1090, 1090, 1), 2: ("", None, None, 0)}
    row = latency_summary(made.withColumn("engine", F.lit("e"))).first()
    assert (row["mean_first_token_us"], row["mean_between_us"]) == (1060, 50)  # an empty answer has no first part


def test_cap_tokens(spark):
    row = spark.range(1).select(F.sequence(F.lit(1), F.lit(9)).alias("ids")).select(calls.cap_tokens("ids", 3).alias("c"))
    assert row.first()["c"] == [1, 2, 3]


def test_map_batches(spark):
    from pyspark.sql import types as T

    from tabloom.operators.mapping import map_batches

    frame = spark.range(10).withColumns({"a": F.col("id") + 1, "b": F.lit("x")})
    added = T.StructType([T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("sum", T.LongType())])

    def total(columns):
        assert set(columns) == {"id", "a"} and len(columns["a"]) <= 3
        return {"sum": [i + a for i, a in zip(columns["id"], columns["a"])], "sizes": [[len(columns["a"])]] * len(columns["a"])}

    made = map_batches(frame, total, added, ["id", "a"], remove=["a"], rows=3)
    assert made.columns == ["id", "b", "sizes", "sum"]
    assert {r["id"]: r["sum"] for r in made.collect()} == {i: 2 * i + 1 for i in range(10)}
    with pytest.raises(Exception, match="one value per row"):
        map_batches(frame, lambda c: {"sum": [1] * 99, "sizes": [[]] * 99}, added, ["id"]).collect()
