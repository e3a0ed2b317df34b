"""Records of text files that span lines, read in as many tasks as a file has splits.

A file is read in pieces that end in one character, which any reader can find from the middle of a file. Whether a piece ends
a record depends on all that stands before it, but only through a small state: inside quotes or not, and how deep brackets are
nested. Each split is first summed up as a map from entry states to exit states and counts of records; the maps of a file are
composed in order, one short row per split; then every split is read knowing its entry state and its first record's number. Whole
records never leave their task. Records that lie across splits are put together from one part per split.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import ship

PIECE_ORDER = ("file", "block")
SUMMARY = "file string, block long, summary string"
ENTRY = "file string, block long, quoted int, depth long, done long"
FRAME = "file string, position long, block long, whole boolean, text string"
# Records that leave a task together.
EMITTED_RECORDS = 4_096

_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL)
_STRING_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
_STRUCTURE = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}]', re.DOTALL)


@dataclass(frozen=True)
class Framing:
    """How a format ends its records.

    ``step(piece, quoted)`` gives whether quotes are open after the piece and its end character, by how much the nesting changed, and
    whether a record can end there; it ends if the depth is then ``level``.
    """

    separator: str
    step: Callable[[str, int], tuple[int, int, bool]]
    level: int = 0
    trim: Callable[[str, bool], str] = lambda text, first: text


def _csv_step(piece: str, quoted: int) -> tuple[int, int, bool]:
    if not quoted and not piece.strip("\r"):
        return 0, 0, False
    after = (quoted + piece.count('"')) & 1
    return after, 0, not after


def _json_step(piece: str, quoted: int) -> tuple[int, int, bool]:
    if quoted:
        closing = _STRING_REST.match(piece)
        if closing is None:
            return 1, 0, False
        piece = piece[closing.end():]
    plain = _STRING.sub("", piece)
    opened = plain.find('"')
    if opened >= 0:
        plain = plain[:opened]
    change = plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")
    return (1, change, False) if opened >= 0 else (0, change - 1, True)


def _element(level: int) -> Callable[[str, bool], str]:
    def trim(text: str, first: bool) -> str:
        """From the brace that opens the record; what stands before it is between records, or opens the file."""
        depth = 0 if first else level
        for mark in _STRUCTURE.finditer(text):
            sign = mark[0]
            if sign == "{" and depth == level:
                return text[mark.start():]
            depth += (sign in "{[") - (sign in "}]")
        return ""

    return trim


CSV = Framing("\n", _csv_step, 0, lambda text, first: text.strip("\r\n"))


def json_elements(level: int = 1) -> Framing:
    """Objects at a depth of nesting: 1 for those of an array file, 2 for those of an array in an object."""
    return Framing("}", _json_step, level, _element(level))


def _pieces(spark: SparkSession, path: str | Sequence[str], framing: Framing) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    read = spark.read.text(paths, lineSep=framing.separator)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    """Neighbouring pieces of one split."""
    files, blocks = (batch.column(i).to_pylist() for i in (1, 2))
    values, start = batch.column(0).to_pylist(), 0
    for at in range(1, len(values) + 1):
        if at == len(values) or (files[at], blocks[at]) != (files[start], blocks[start]):
            yield files[start], blocks[start], values[start:at]
            start = at


def _summarise(framing: Framing):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, block, values in _runs(batch):
                states = held.setdefault((file, block), [[0, 0, Counter()], [1, 0, Counter()]])
                for state in states:
                    quoted, depth, ends = state
                    for value in values:
                        quoted, change, may_end = framing.step(value, quoted)
                        depth += change
                        if may_end:
                            ends[depth] += 1
                    state[0], state[1] = quoted, depth
        rows = [(file, block, json.dumps([[q, d, {str(k): n for k, n in e.items()}] for q, d, e in states])) for (file, block), states in held.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "block", "summary"]
        )

    return step


def _compose(level: int):
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        """Entry state of every split of a file, in order."""
        quoted = depth = done = 0
        out = []
        for file, block, summary in rows.sort_values("block")[["file", "block", "summary"]].itertuples(index=False):
            out.append((file, block, quoted, depth, done))
            after, change, ends = json.loads(summary)[quoted]
            done += ends.get(str(level - depth), 0)
            quoted, depth = after, depth + change
        return pd.DataFrame(out, columns=["file", "block", "quoted", "depth", "done"])

    return step


def _frame(framing: Framing, whole: bool):
    """Emits the whole records of every split, or the parts of those that lie across splits."""
    end = framing.separator

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        here, held, quoted, depth, done, leading = None, [], 0, 0, 0, True

        def emit(is_whole: bool, text: str) -> None:
            if is_whole != whole:
                return
            kept = framing.trim(text, done == 0) if is_whole else text
            if kept:
                out.append((here[0], done, here[1], is_whole, kept))

        def rows() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            made = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["file", "position", "block", "whole", "text"]
            )
            out.clear()
            return made

        for batch in batches:
            entries = [batch.column(i).to_pylist() for i in (3, 4, 5)]
            offset = 0
            for file, block, values in _runs(batch):
                if (file, block) != here:
                    if held:
                        emit(False, end.join(held) + end)
                    here, held, leading = (file, block), [], block > 0
                    quoted, depth, done = (column[offset] for column in entries)
                for value in values:
                    held.append(value)
                    quoted, change, may_end = framing.step(value, quoted)
                    depth += change
                    if may_end and depth == framing.level:
                        # The first one of a later split may have begun before it.
                        emit(not leading, end.join(held) + end)
                        held, leading = [], False
                        done += 1
                offset += len(values)
                if len(out) >= EMITTED_RECORDS:
                    yield rows()
        if held:
            emit(False, end.join(held) + end)
        yield rows()

    return step


def _merged(framing: Framing):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, positions, texts = (batch.column(i).to_pylist() for i in range(3))
            kept = [(f, p, framing.trim(t, p == 0)) for f, p, t in zip(files, positions, texts)]
            kept = [row for row in kept if row[2]]
            types = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], t) for i, t in enumerate(types)], names=["file", "position", "text"])

    return step


def records(spark: SparkSession, path: str | Sequence[str], framing: Framing) -> DataFrame:
    """``file, position, text``: the records of all files with their place in the file, from 0.

    Reads the files three times, once for the states and once each for whole records and parts, and shuffles only parts, two per
    split unless a record is longer than one. One row per split, a millionth of the data, is composed per file and
    broadcast. A record is held whole by one task.
    """
    ship(spark)
    pieces = _pieces(spark, path, framing)
    summaries = pieces.mapInArrow(_summarise(framing), SUMMARY)
    entries = summaries.groupBy("file").applyInPandas(_compose(framing.level), ENTRY)
    placed = pieces.join(F.broadcast(entries), list(PIECE_ORDER)).select("value", *PIECE_ORDER, "quoted", "depth", "done")
    inside = placed.mapInArrow(_frame(framing, True), FRAME).select("file", "position", "text")
    parts = placed.mapInArrow(_frame(framing, False), FRAME)
    listed = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = parts.groupBy("file", "position").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text"))
    across = joined.mapInArrow(_merged(framing), "file string, position long, text string")
    return inside.unionByName(across)
