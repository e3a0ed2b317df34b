"""Word-level vocabulary: counting, encoding and decoding.

It stands in where no pretrained tokenizer is at hand; rank files of one are read by
:mod:`tabloom.operators.subwords`, and any other plugs in through :func:`encode_with`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import tokens
from tabloom.functions.tokens import SpecialIds
from tabloom.operators.ordering import key_position

BROADCAST_BYTES = 64 << 20
ENTRY_BYTES = 64
UNKNOWN_TOKEN = "<unk>"
# Entries of a large vocabulary that are broadcast on their own.
FREQUENT_ENTRIES = 50_000
# Tokens that are looked up and regrouped in one task, so that sorting them does not spill.
TASK_TOKENS = 1_000_000


def token_counts(texts: DataFrame, text: str = "text", special: SpecialIds = SpecialIds(), spaced: bool = False) -> DataFrame:
    """How often each token occurs, markers aside; partial counts are formed before the shuffle."""
    exploded = texts.select(F.explode(tokens.split_tokens(F.col(text), special.markers, spaced)).alias("token"))
    if special.markers:
        exploded = exploded.filter(~F.col("token").isin([name for name, _ in special.markers]))
    return exploded.groupBy("token").agg(F.count("*").alias("n"))


def build_vocabulary(
    texts: DataFrame, text: str = "text", size: int | None = None, special: SpecialIds = SpecialIds(), spaced: bool = False
) -> DataFrame:
    """``token, n, id``: all tokens, or the ``size`` most frequent ones if asked for; ties by token.

    Tokens are numbered bucket by bucket, whatever their number. ``spaced`` tokens hold the blanks before them, for ids that give
    back the exact text: encode and decode with it as well.
    """
    counted = token_counts(texts, text, special, spaced)
    ranked = key_position(counted.withColumn("_rare", -F.col("n")), ["_rare", "token"], out="_rank").drop("_rare")
    if size is not None:
        ranked = ranked.filter(F.col("_rank") < size)
    return ranked.select("token", "n", (F.col("_rank") + special.first_free).cast("int").alias("id"))


def fits_broadcast(vocabulary: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measured size of a stored vocabulary against the limit."""
    size = F.sum(F.octet_length("token") + ENTRY_BYTES)
    return (vocabulary.agg(F.coalesce(size, F.lit(0)).alias("size")).first()["size"]) <= limit


def _with_markers(vocabulary: DataFrame, special: SpecialIds) -> DataFrame:
    """The vocabulary and a row per marker; the number of markers is that of the setting."""
    if not special.markers:
        return vocabulary
    rows = vocabulary.sparkSession.createDataFrame([(name, 1 << 62, number) for name, number in special.markers], "token string, n long, id int")
    return vocabulary.select("token", "n", F.col("id").cast("int").alias("id")).unionByName(rows)


def _entries(vocabulary: DataFrame, broadcast: bool) -> tuple[DataFrame, DataFrame | None]:
    """``_token, _id`` to broadcast, and all of them if these are not all.

    Of a vocabulary too large to broadcast the most frequent entries, which could each hold a large share of all tokens, are broadcast
    when they fit. No single one of the others is frequent.
    """
    named = lambda rows: rows.select(F.col("token").alias("_token"), F.col("id").cast("int").alias("_id"))
    if broadcast:
        return named(vocabulary), None
    frequent = vocabulary.orderBy(F.desc("n"), "token").limit(FREQUENT_ENTRIES)
    return named(frequent if fits_broadcast(frequent) else vocabulary.limit(0)), named(vocabulary)


def _gathered(rows: DataFrame, rare: DataFrame | None, key: Sequence[str], vocabulary: DataFrame) -> DataFrame:
    """Lists of rows and what was looked up for their rare parts, dealt by key; ``rare`` is ``key, _at, _found``.

    They come together by key once and stay there. The counts of the vocabulary tell into how many tasks.
    """
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if "n" in vocabulary.columns else 0
    tasks = max(2, -(-total // TASK_TOKENS))
    if rare is None:
        every = rows.withColumns({"_at": F.lit(None).cast("int"), "_found": F.lit(None)})
    else:
        every = rows.unionByName(rare, allowMissingColumns=True)
    return every.repartition(tasks, *key)


def encode(
    texts: DataFrame, vocabulary: DataFrame, key: Sequence[str], text: str = "text",
    max_length: int | None = None, add_special: bool = False, special: SpecialIds = SpecialIds(),
    broadcast: bool | None = None, spaced: bool = False,
) -> DataFrame:
    """``key, input_ids, length`` of every text, unknown tokens included, cut to ``max_length`` if given.

    Texts are split and cut where they are read, and the remaining tokens travel once, by key, as one
    compact blank-separated text. Exploding, looking up and regrouping then happen inside those
    partitions. Tokens that are not among the broadcast entries are looked up before, by token, and meet their text there; texts are then
    read twice. ``broadcast`` is measured when not given: pass a stored vocabulary. Markers of ``special`` are one
    token each, with the ids given there. Keys must be unique: the tokens of rows with one key come out as one list.
    """
    if broadcast is None:
        broadcast = fits_broadcast(vocabulary)
    near, entries = _entries(_with_markers(vocabulary, special), broadcast)
    words = tokens.split_tokens(F.coalesce(F.col(text), F.lit("")), special.markers, spaced)
    if max_length is not None:
        words = tokens.truncated(words, max_length - (2 if add_special else 0))
    rare = None
    if entries is not None:
        open_ = texts.select(*key, F.posexplode(words).alias("_at", "_token")).join(F.broadcast(near), "_token", "left_anti")
        rare = open_.join(entries, "_token", "left").select(*key, "_at", F.coalesce("_id", F.lit(special.unknown)).alias("_found"))
    # Tokens travel as one text; those with blanks are told apart again by the same rule.
    compact = texts.select(*key, F.array_join(words, "" if spaced else " ").alias("_words"))
    again = tokens.split_tokens(F.col("_words"), special.markers, spaced=True)
    listed = again if spaced else F.when(F.col("_words") != "", F.split("_words", " "))
    exploded = _gathered(compact, rare, key, vocabulary).select(*key, "_at", "_found", F.posexplode_outer(listed).alias("_pos", "_token"))
    found = F.coalesce("_found", "_id") if entries is not None else F.coalesce("_id", F.lit(special.unknown))
    # Position above, id below: one long per token sorts without comparing structs.
    packed = F.shiftleft(F.coalesce("_at", "_pos").cast("long"), 32) + found
    ids = (
        exploded.join(F.broadcast(near), "_token", "left")
        .select(*key, packed.alias("_one"))
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("_one")).alias("_packed"))
    )
    unpacked = F.transform("_packed", lambda p: (p % F.lit(1 << 32)).cast("int"))
    framed = tokens.framed(unpacked, special) if add_special else unpacked
    return ids.select(*key, framed.alias("input_ids"), (F.size("_packed") + (2 if add_special else 0)).alias("length"))


def decode(
    encoded: DataFrame, vocabulary: DataFrame, key: Sequence[str], ids: str = "input_ids", out: str = "text",
    special: SpecialIds = SpecialIds(), skip_special: bool = True, broadcast: bool | None = None, spaced: bool = False,
) -> DataFrame:
    """``key, text``: tokens joined by single blanks, or as they are if ``spaced``, which gives the text that was encoded.

    Ids are looked up as tokens are by :func:`encode`; those that are unknown are not shuffled on their own.
    """
    if broadcast is None:
        broadcast = fits_broadcast(vocabulary)
    near, entries = _entries(_with_markers(vocabulary, special), broadcast)
    reserved = sorted({special.begin, special.end, special.padding})
    kept = tokens.without_ids(F.col(ids), reserved) if skip_special else F.col(ids)
    lists, rare = encoded.select(*key, kept.alias("_ids")), None
    if entries is not None:
        open_ = lists.select(*key, F.posexplode("_ids").alias("_at", "_id")).filter(F.col("_id") != special.unknown)
        open_ = open_.join(F.broadcast(near), "_id", "left_anti")
        rare = open_.join(entries, "_id", "left").select(*key, "_at", F.coalesce("_token", F.lit(UNKNOWN_TOKEN)).alias("_found"))
    exploded = _gathered(lists, rare, key, vocabulary).select(*key, "_at", "_found", F.posexplode_outer("_ids").alias("_pos", "_id"))
    hopeless = F.coalesce(F.col("_id") == special.unknown, F.lit(True)) if entries is not None else F.lit(True)
    token = F.coalesce("_found", "_token", F.when(hopeless, UNKNOWN_TOKEN))
    place = F.coalesce("_at", "_pos")
    pair = F.when(place.isNotNull() & token.isNotNull(), F.struct(place.alias("pos"), token.alias("token")))
    named = exploded.join(F.broadcast(near), "_id", "left").select(*key, pair.alias("_pair"))
    gathered = named.groupBy(*key).agg(F.sort_array(F.collect_list("_pair")).alias("_pairs"))
    return gathered.select(*key, F.array_join(F.transform("_pairs", lambda p: p["token"]), "" if spaced else " ").alias(out))


class Tokenizer(Protocol):
    """A user tokenizer: texts in, one id list per text out."""

    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...


def encode_with(make: Callable[[], Tokenizer], column: Column, max_length: int | None = None) -> Column:
    """Ids from a user tokenizer, built once per task and fed whole Arrow batches; needs no shuffle."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for batch in batches:
            encoded = tokenizer.encode_batch(batch.fillna("").tolist())
            yield pd.Series([list(ids)[:max_length] for ids in encoded], index=batch.index, dtype=object)

    return run(column)
