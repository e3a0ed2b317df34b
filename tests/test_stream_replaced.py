"""A board in which repeated responses replace earlier ones, against the last responses summed up in batch."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import types as T

from tabloom.sources import versions
from tabloom.streaming import scoreboard

SCHEMA = T.StructType().add("experiment_id", "string").add("evaluation_type", "string").add("example_id", "long").add("attempt", "long").add("raw", "string")


def expected(rows):
    last = {}
    for r in rows:
        at = (r["experiment_id"], r["evaluation_type"], r["example_id"])
        if at not in last or (r["attempt"] or 0) > (last[at]["attempt"] or 0):
            last[at] = r
    out = {}
    for (experiment, kind, _), r in last.items():
        board = out.setdefault((experiment, kind), [[], [], 0])
        board[2] += 1
        try:
            scores = json.loads(r["raw"] or "")
            board[0].append(scores["first_score"])
            board[1].append(scores["second_score"])
        except ValueError:
            pass
    return {k: (sum(a) / len(a) if a else 0, sum(b) / len(b) if b else 0, len(a), n) for k, (a, b, n) in out.items()}


def found(frame):
    return {
        (r["experiment_id"], r["evaluation_type"]): (r["finetuned_avg"], r["base_avg"], r["valid"], r["responses"]) for r in frame.collect()
    }


def response(key, attempt, first, experiment="e1", kind="a", second=1):
    raw = None if first is None else json.dumps({"first_score": first, "second_score": second}) if first >= 0 else "broken"
    return {"experiment_id": experiment, "evaluation_type": kind, "example_id": key, "attempt": attempt, "raw": raw}


def test_repeated_responses_replace(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    deliveries = [
        [response(i, 0, i % 7) for i in range(60)] + [response(i, 0, i % 3, "e2", "b") for i in range(5)],
        [response(i, 0, i % 7) for i in range(30)],  # delivered twice
        [response(3, 1, 10), response(4, 1, -1), response(5, 2, None), response(3, 1, 9)] + [response(1, 1, 0.5, "e2", "b")],
        [response(4, 2, 6), response(5, 1, 8), response(6, None, 9), response(900, None, 2)] * 2,
        [response(7, 1, 0, "e3", "a")],
    ]
    seen = []
    for number, rows in enumerate(deliveries):
        (source / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
        seen += rows
        stream = scoreboard.response_stream(spark, str(source), SCHEMA, files_per_batch=1, state_partitions=2)
        scoreboard.start_replacing_scoreboard(stream, ["example_id"], out, progress, available_now=True).awaitTermination()
        assert found(scoreboard.latest_board(spark, out)) == expected(seen)
    kept = versions.numbers(spark, f"{out}/published")
    assert len(kept) == scoreboard.KEPT_VERSIONS == len(list((tmp_path / "out" / "boards").iterdir()))


def test_a_batch_is_published_once(spark, tmp_path):
    out = str(tmp_path / "out")
    assert scoreboard.latest_board(spark, out) is None
    scoreboard._publish(spark.range(3), out, 0)
    scoreboard._publish(spark.range(9), out, 0)  # repeated after it was named
    assert scoreboard.latest_board(spark, out).count() == 3
    spark.range(5).write.parquet(f"{out}/boards/1-half")  # written, not named
    assert scoreboard.latest_board(spark, out).count() == 3 and scoreboard.latest_board(spark, out, before=0) is None


def test_state_is_read_and_written_in_blocks_of_keys():
    """Not once or more per key: every access is a message to the JVM."""
    stored, messages = {}, []

    class Map:
        def getValue(self, key):
            messages.append(key)
            return stored.get(key)

        def updateValue(self, key, value):
            messages.append(key)
            stored[key] = value

    board, keys = scoreboard.LastScores(), 5_000
    board.init(type("Handle", (), {"getMapState": lambda self, *_: Map()})())
    for attempt, sums in ((0, (keys, keys, keys, keys)), (0, (0, 0, 0, 0)), (1, (keys, 0, 0, 0))):
        rows = pd.DataFrame({"item": [f"k{i}" for i in range(keys)], "attempt": attempt, "valid": True, "first": Decimal(1 + attempt), "second": Decimal(1)})
        messages.clear()
        (told,) = board.handleInputRows(("e", "a"), iter([rows]), None)
        assert tuple(told.loc[0, ["first", "second", "valid", "responses"]]) == sums
        assert len(messages) <= 2 * scoreboard.KEY_BLOCKS
