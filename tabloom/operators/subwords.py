"""Pretrained byte-level subwords: encoding, exact decoding and counts over a published rank file.

Nothing is trained here. Texts are cut into pieces where they are read; what is left to Python is the merging of pieces, once per
distinct piece of a batch, so neither encoding nor decoding shuffles.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import tokens
from tabloom.functions.tokens import SpecialIds
from tabloom.session import ship

# Contractions, words, numbers and signs with the blank before them, runs of white space: together they cover every text.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Distinct pieces a task remembers between batches.
REMEMBERED = 50_000
# Pieces or ids that a task handles at once, one row at least.
AT_ONCE = 200_000


@dataclass(frozen=True)
class Subwords:
    """A rank file, one ``base64 rank`` pair a line, and the ids its model reserves beside it.

    Markers of ``special`` are one id each wherever they stand in a text. The file is read on the driver, and every
    task gets its entries: a vocabulary of some tens of thousands.
    """

    path: str
    special: SpecialIds = field(default_factory=SpecialIds)
    pattern: str = PIECES

    def ranks(self) -> dict[bytes, int]:
        return _ranks(self.path)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the neighbours whose union ranks lowest are joined, the leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    end_of, begin_of = list(range(1, size + 1)), {i + 1: i for i in range(size)}
    waiting: list[tuple[int, int, int, int]] = []

    def offer(start: int) -> None:
        middle = end_of[start]
        if middle < size:
            rank = ranks.get(piece[start:end_of[middle]])
            if rank is not None:
                heapq.heappush(waiting, (rank, start, middle, end_of[middle]))

    for start in range(size - 1):
        offer(start)
    while waiting:
        _, start, middle, end = heapq.heappop(waiting)
        # Either half has been joined with something else since.
        if end_of[start] != middle or end_of[middle] != end:
            continue
        end_of[start], end_of[middle] = end, -1
        del begin_of[middle]
        begin_of[end] = start
        offer(start)
        if start in begin_of:
            offer(begin_of[start])
    out, start = [], 0
    while start < size:
        out.append(ranks[piece[start:end_of[start]]])
        start = end_of[start]
    return out


def pieces(text: Column, subwords: Subwords) -> Column:
    """The text cut into pieces, markers whole; none for null."""
    text = F.coalesce(text, F.lit(""))
    cut = lambda part: F.regexp_extract_all(part, F.lit(subwords.pattern), F.lit(0))
    names = sorted((name for name, _ in subwords.special.markers), key=len, reverse=True)
    if not names:
        return cut(text)
    marker = "|".join(re.sub(r"([^\w\s])", r"\\\1", name) for name in names)
    # Texts between markers, and the markers, in turn.
    between, found = F.split(text, marker, -1), F.regexp_extract_all(text, F.lit(marker), F.lit(0))
    joined = F.zip_with(between, found, lambda part, name: F.concat(cut(part), F.when(name.isNotNull(), F.array(name)).otherwise(F.array())))
    return F.flatten(joined)


def _parts(batches: Iterator[pa.RecordBatch], carried: int, size: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose lists at place ``carried`` are not long together, one row at least."""
    for batch in batches:
        ends, start = batch.column(carried).offsets.to_numpy(), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def _encoder(subwords: Subwords, ranks: dict[bytes, int], max_length: int | None, carried: int):
    markers = dict(subwords.special.markers)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, list[int]] = {}
        for batch in _parts(batches, carried):
            listed = batch.column(carried)
            coded = listed.flatten().dictionary_encode()
            known = []
            for piece in coded.dictionary.to_pylist():
                ids = remembered.get(piece)
                if ids is None:
                    ids = [markers[piece]] if piece in markers else merged(piece.encode(), ranks)
                    if len(remembered) < REMEMBERED:
                        remembered[piece] = ids
                known.append(ids)
            by_piece = pa.array(known, pa.list_(pa.int32())).take(coded.indices)
            widths = np.diff(by_piece.offsets.to_numpy()) if len(by_piece) else np.empty(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(widths)))
            offsets = ends[listed.offsets.to_numpy() - listed.offsets[0].as_py()]
            flat, lengths = by_piece.flatten(), np.diff(offsets)
            if max_length is not None:
                lengths = np.minimum(lengths, max_length)
                starts = np.concatenate(([0], np.cumsum(lengths)))
                flat = flat.take(pa.array(np.arange(starts[-1]) + np.repeat(offsets[:-1] - starts[:-1], lengths)))
                offsets = starts
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], ids, pa.array(lengths, pa.int32())], names=[*batch.schema.names[:carried], "input_ids", "length"]
            )

    return step


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def encode(
    texts: DataFrame, subwords: Subwords, key: Sequence[str], text: str = "text", max_length: int | None = None,
    add_special: bool = False,
) -> DataFrame:
    """``key, input_ids, length`` of every row, in place: nothing is shuffled and keys need not be unique.

    With ``max_length`` as many pieces are read, as each is an id at least, and the ids are cut to it, begin and end ids included.
    """
    ship(texts.sparkSession)
    limit = None if max_length is None else max_length - (2 if add_special else 0)
    cut = pieces(F.col(text), subwords)
    rows = texts.select(*key, (cut if limit is None else F.slice(cut, 1, limit)).alias("_pieces"))
    made = rows.mapInArrow(
        _encoder(subwords, subwords.ranks(), limit, len(key)), f"{_ddl(rows, key)}, input_ids array<int>, length int"
    )
    if not add_special:
        return made
    return made.select(*key, tokens.framed(F.col("input_ids"), subwords.special).alias("input_ids"), (F.col("length") + 2).alias("length"))


def _decoder(table: list[bytes], carried: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(table, pa.binary())
        for batch in _parts(batches, carried):
            listed = batch.column(carried)
            ids = listed.flatten().to_numpy(zero_copy_only=False)
            inside = (ids >= 0) & (ids < len(table))
            parts = known.take(pa.array(np.where(inside, ids, len(table) - 1)))
            ends = np.concatenate(([0], np.cumsum(pa.compute.binary_length(parts).to_numpy(zero_copy_only=False))))
            offsets = ends[listed.offsets.to_numpy() - listed.offsets[0].as_py()].astype(np.int64)
            # The parts lie one after the other, so a text is a stretch of them.
            joined = memoryview(parts.buffers()[2] or b"")
            texts = [str(joined[a:b], "utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], pa.array(texts, pa.string())], names=[*batch.schema.names[:carried], "text"])

    return step


def decode(encoded: DataFrame, subwords: Subwords, key: Sequence[str], ids: str = "input_ids", skip_special: bool = True) -> DataFrame:
    """``key, text``: exactly the text that was encoded, in place, nothing shuffled.

    Ids that neither the file nor a marker has give nothing; reserved ids do not either, unless kept. An id sequence cut inside a
    character ends in the replacement character.
    """
    ship(encoded.sparkSession)
    special, ranks = subwords.special, subwords.ranks()
    names = {number: name.encode() for name, number in special.markers}
    dropped = {special.begin, special.end, special.padding} - set(ranks.values()) if skip_special else set()
    table = [b""] * (2 + max([*ranks.values(), *names]))
    for number, name in [*((n, t) for t, n in ranks.items()), *names.items()]:
        table[number] = b"" if number in dropped else name
    rows = encoded.select(*key, F.coalesce(F.col(ids), F.array().cast("array<int>")).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(_decoder(table, len(key)), f"{_ddl(rows, key)}, text string")


def _counter(subwords: Subwords, ranks: dict[bytes, int]):
    markers = dict(subwords.special.markers)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [markers[piece]] if piece in markers else merged(piece.encode(), ranks)
                found.extend(ids)
                counts.extend([n] * len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts, pa.int64())], names=["id", "n"])

    return step


def entries(spark: SparkSession, subwords: Subwords) -> DataFrame:
    """``id, token``: the entries of the rank file as bytes, and the markers."""
    rows = [(number, bytearray(token)) for token, number in subwords.ranks().items()]
    rows += [(number, bytearray(name.encode())) for name, number in subwords.special.markers]
    return spark.createDataFrame(rows, "id int, token binary")


def count_subwords(texts: DataFrame, subwords: Subwords, text: str = "text") -> DataFrame:
    """``id, token, n``: how often each entry occurs in the texts; entries that do not occur are left out.

    Pieces are counted first, with partial counts before the shuffle, so each distinct one is merged once however often it stands.
    """
    ship(texts.sparkSession)
    counted = texts.select(F.explode(pieces(F.col(text), subwords)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    parts = counted.mapInArrow(_counter(subwords, subwords.ranks()), "id int, n long")
    totals = parts.groupBy("id").agg(F.sum("n").alias("n"))
    return totals.join(F.broadcast(entries(texts.sparkSession, subwords)), "id").select("id", "token", "n")
