"""Scores that keep up with arriving judge responses."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tabloom.operators.summaries import score_summary, with_scores
from tabloom.schemas import COMPARISON_FILE
from tabloom.session import delete, ship
from tabloom.sources import versions

# Partial sums are formed where files are read, so a handful of state partitions serves any input.
STATE_PARTITIONS = 4
# Where state is a row per key it is spread over more of them, and kept outside the memory of executors.
KEYED_PARTITIONS = 32
KEY_SHARES = 256
# Keys of a share that are read and written together: blocks hold few keys, so a response moves few others.
KEY_BLOCKS = 512
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT_VERSIONS = 3
CHANGES = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("evaluation_type", T.StringType()),
        T.StructField("first", T.DecimalType(38, 10)),
        T.StructField("second", T.DecimalType(38, 10)),
        T.StructField("valid", T.LongType()),
        T.StructField("responses", T.LongType()),
    ]
)


def response_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, state_partitions: int = KEYED_PARTITIONS
) -> DataFrame:
    """Keyed judge responses as JSON-line files arrive, in a session whose state is kept per key."""
    ship(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", KEYED_STORE)
    reader = own.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def comparison_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None, state_partitions: int = STATE_PARTITIONS
) -> DataFrame:
    """Judge responses as JSON-line files arrive below ``path``.

    The stream has a session of its own, whose number of shuffle partitions fits its small state.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    reader = own.readStream.schema(COMPARISON_FILE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def score_stream(comparisons: DataFrame) -> DataFrame:
    """The summary of :func:`score_summary` per evaluation type; state is one row per type."""
    return score_summary(with_scores(comparisons), ["evaluation_type"])


def _publish(board: DataFrame, out: str, batch: int) -> None:
    """Store a version of the board and then name it; a batch that is repeated after that is left as it is.

    Every attempt writes a folder of its own, so nothing that a reader may have open is written again. Of older versions, those
    that readers can no longer be about to open are deleted.
    """
    spark = board.sparkSession
    if batch in versions.numbers(spark, f"{out}/published"):
        return
    folder = f"{out}/boards/{batch}-{uuid.uuid4().hex}"
    board.coalesce(1).write.parquet(folder)
    versions.make_once(spark, versions.version_file(f"{out}/published", batch), json.dumps({"folder": folder}))
    for old in versions.numbers(spark, f"{out}/published")[:-KEPT_VERSIONS]:
        entry = versions.entry_of(spark, f"{out}/published", old)
        delete(spark, versions.version_file(f"{out}/published", old))
        if entry is not None:
            delete(spark, entry["folder"])


def start_scoreboard(comparisons: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the board below ``out``, one complete version per batch."""
    writer = score_stream(comparisons).writeStream.outputMode("complete").foreachBatch(
        lambda board, batch: _publish(board, out, batch)
    )
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_board(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The newest published version of the board, or the newest one before a batch; None before the first."""
    for number in reversed(versions.numbers(spark, f"{out}/published")):
        if before is None or number < before:
            entry = versions.entry_of(spark, f"{out}/published", number)
            if entry is not None:
                return spark.read.parquet(entry["folder"])
    return None


class LastScores(StatefulProcessor):
    """Per experiment and share of its keys: the last response of every key, and by how much it changes the sums.

    A response replaces one of a lower attempt; one of the same or a higher attempt that is known already changes nothing. Keys are stored
    in blocks, as every access to the state is a message to the JVM.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._blocks = handle.getMapState("blocks", "block int", "entries string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        for batch in rows:
            for item, attempt, valid, first, second in zip(*(batch[c].tolist() for c in ("item", "attempt", "valid", "first", "second"))):
                if item not in newest or attempt > newest[item][0]:
                    newest[item] = (int(attempt), bool(valid), first, second)
        blocks: dict[int, list[str]] = {}
        for item in newest:
            blocks.setdefault(zlib.crc32(item.encode()) % KEY_BLOCKS, []).append(item)
        change = [Decimal(0), Decimal(0), 0, 0]
        for block, items in blocks.items():
            stored, replaced = self._blocks.getValue((block,)), False
            known = json.loads(stored[0]) if stored else {}
            for item in items:
                now, before = newest[item], known.get(item)
                if before is not None and before[0] >= now[0]:
                    continue
                known[item], replaced = [now[0], now[1], *(map(str, now[2:]) if now[1] else ())], True
                for (_, valid, *scores), sign in ((now, 1), *([(before, -1)] if before is not None else [])):
                    change[3] += sign
                    if valid:
                        change[0], change[1], change[2] = change[0] + sign * Decimal(scores[0]), change[1] + sign * Decimal(scores[1]), change[2] + sign
            if replaced:
                self._blocks.updateValue((block,), (json.dumps(known),))
        if newest:
            yield pd.DataFrame({
                "experiment_id": [key[0]], "evaluation_type": [key[1]], "first": [change[0]], "second": [change[1]],
                "valid": [change[2]], "responses": [change[3]],
            })

    def close(self) -> None:
        pass


def score_changes(responses: DataFrame, key: Sequence[str]) -> DataFrame:
    """By how much arriving responses change the sums of their experiments.

    ``responses`` stream ``experiment_id, evaluation_type``, key columns, ``attempt`` and ``raw``. State is the last scores per key; keys
    of an experiment are dealt to ``KEY_SHARES`` shares, so a large experiment is spread over tasks. Scores count to ten decimals.
    """
    scored = with_scores(responses)
    item = F.to_json(F.struct(*key))
    sums = [F.col(f"{n}_score").cast("decimal(38,10)").alias(n) for n in ("first", "second")]
    rows = scored.select(
        "experiment_id", "evaluation_type", F.pmod(F.xxhash64(item), F.lit(KEY_SHARES)).alias("share"), item.alias("item"),
        F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt"), "valid", *sums,
    )
    return rows.groupBy("experiment_id", "evaluation_type", "share").transformWithStateInPandas(
        LastScores(), CHANGES, "update", "None"
    )


def _advance(changes: DataFrame, out: str, batch: int) -> None:
    """Add the changes of a batch to the board before it; replayed, the same changes meet the same board."""
    before = latest_board(changes.sparkSession, out, before=batch)
    every = changes if before is None else changes.unionByName(before.select(*CHANGES.fieldNames()))
    sums = every.groupBy("experiment_id", "evaluation_type").agg(
        *[F.sum(n).cast(CHANGES[n].dataType).alias(n) for n in ("first", "second", "valid", "responses")]
    )
    mean = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col("valid")), F.lit(0.0))
    _publish(sums.withColumns({"finetuned_avg": mean("first"), "base_avg": mean("second")}), out, batch)


def start_replacing_scoreboard(
    responses: DataFrame, key: Sequence[str], out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep a board per experiment below ``out`` in which a repeated response replaces the one before it."""
    writer = score_changes(responses, key).writeStream.outputMode("update").foreachBatch(
        lambda changes, batch: _advance(changes, out, batch)
    )
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
