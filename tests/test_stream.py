"""The scoreboard agrees with the batch summary at every point."""

import json

from tabloom.operators.summaries import score_summary, with_scores
from tabloom.streaming import scoreboard


def board(frame):
    return {r["evaluation_type"]: tuple(r[c] for c in ("finetuned_avg", "base_avg", "total_comparisons", "all_comparisons")) for r in frame.collect()}


def test_stream_equals_batch_as_files_arrive(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    for step in range(3):
        for part in range(2):
            rows = [
                {"evaluation_type": "ab"[i % 2], "raw": json.dumps({"first_score": i, "second_score": step}) if i % 5 else "broken"}
                for i in range(20)
            ] + [{"evaluation_type": "a", "raw": None}]
            (source / f"{step}-{part}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = scoreboard.comparison_stream(spark, str(source), files_per_batch=1)
        scoreboard.start_scoreboard(stream, out, progress, available_now=True).awaitTermination()
        whole = spark.read.schema("evaluation_type string, raw string").json(str(source))
        expected = board(score_summary(with_scores(whole), ["evaluation_type"]))
        assert board(scoreboard.latest_board(spark, out)) == expected
        assert sum(v[3] for v in expected.values()) == 42 * (step + 1)
