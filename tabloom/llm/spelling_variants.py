"""Spelling variants: words one edit apart, found through pivotal grams.

The bigrams of a word are ordered by how many words hold them, rarest first. One edit harms at most two bigrams, so of the three
rarest of a word one survives in any near word, and of two that do not overlap, its pivots, one survives as well. Of two near words
take the one whose third rarest bigram comes first: its surviving pivot is among the rarest bigrams of the other, its prefix.

A surviving pivot has the edit on one side. On the other side both words are equal, and the pivot stands as far from that end in
both. On the side of the edit one half of what remains is equal too. So a pivot is posted with the text on its quiet side and one half
of the other side, and posting lists hold words that share half of their letters and more, not all words with a common bigram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER, arrow_map, column
from tabloom.session import materialize

RUNS = "[a-z\\u00C0-\\u00FF]++"
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form stands this many times as often as the word.
FORM_RATIO = 10
# One run in this many loses a code point.
DROPPED_ONE_IN = 31
# Rarest bigrams that one edit cannot all harm.
PREFIX = 3
# Words whose postings make up a batch.
POSTED_WORDS = 2_000
# Steps from form to form double each round: 2 ** 6 is above the decimal digits of any count.
ROUNDS = 6


def words(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts after the deletion that id and run decide, with their occurrences."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), F.lit(0))
    long = F.filter(runs, lambda w: F.length(w) >= LEAST_LENGTH)
    exploded = docs.select(key.alias("_key"), F.explode(long).alias("_run"))
    hashed = F.crc32(F.concat_ws(":", "_key", "_run").cast("binary"))
    counted = exploded.select(_shortened(F.col("_run"), hashed).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _shortened(run: Column, hashed: Column) -> Column:
    at = F.pmod(hashed, F.length(run)).cast("int")
    rest = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(hashed, F.lit(DROPPED_ONE_IN)) == 0, rest).otherwise(run)


def bigrams(vocabulary: DataFrame) -> DataFrame:
    """``gram, words``: in how many words each bigram stands; as many rows as pairs of letters at most."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    return vocabulary.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("words"))


def prefix(word: str, rank: dict[str, int]) -> list[int]:
    """Where the ``PREFIX`` rarest bigrams start, in order of place; all places of the last of them count."""
    ranked = sorted(rank[word[i:i + 2]] for i in range(len(word) - 1))
    last = ranked[min(PREFIX, len(ranked)) - 1]
    return [i for i in range(len(word) - 1) if rank[word[i:i + 2]] <= last]


def pivots(word: str, places: list[int], rank: dict[str, int]) -> tuple[int, int]:
    """Two bigrams of the prefix that do not overlap and are rarest together.

    By dynamic programming over the places: the best single one that ends before a place, and the best pair so far. Three places
    always hold two that do not overlap.
    """
    best: tuple[int, int, int] | None = None
    single: tuple[int, int] | None = None
    waiting: list[int] = []
    for place in places:
        while waiting and waiting[0] <= place - 2:
            earlier = waiting.pop(0)
            cost = rank[word[earlier:earlier + 2]]
            if single is None or cost < single[0]:
                single = (cost, earlier)
        if single is not None:
            pair = (single[0] + rank[word[place:place + 2]], single[1], place)
            if best is None or pair < best:
                best = pair
        waiting.append(place)
    return best[1], best[2]


def _quiet_left(word: str, place: int, rest: int) -> set[str]:
    """Keys of a bigram whose left side is quiet, if the posted word has ``rest`` letters after it."""
    head, after = word[:place + 2], len(word) - place - 2
    first, second = rest // 2, rest - rest // 2
    keys = set()
    if first <= after:
        keys.add(f"L{place}a{head}|{word[place + 2:place + 2 + first]}")
    if second <= after:
        keys.add(f"L{place}b{head}|{word[len(word) - second:]}")
    return keys


def _quiet_right(word: str, place: int, rest: int) -> set[str]:
    """Keys of a bigram whose right side is quiet, if the posted word has ``rest`` letters before it."""
    tail = word[place:]
    first, second = rest // 2, rest - rest // 2
    keys = set()
    if first <= place:
        keys.add(f"R{len(tail)}a{tail}|{word[:first]}")
    if second <= place:
        keys.add(f"R{len(tail)}b{tail}|{word[place - second:place]}")
    return keys


def pivot_keys(word: str, rank: dict[str, int]) -> set[str]:
    keys = set()
    for place in pivots(word, prefix(word, rank), rank):
        keys |= _quiet_left(word, place, len(word) - place - 2) | _quiet_right(word, place, place)
    return keys


def prefix_keys(word: str, rank: dict[str, int]) -> set[str]:
    """Keys under which the pivots of near words can be posted; their lengths differ by one at most."""
    keys = set()
    for place in prefix(word, rank):
        after = len(word) - place - 2
        for more in (-1, 0, 1):
            if after + more >= 0:
                keys |= _quiet_left(word, place, after + more)
            if place + more >= 0:
                keys |= _quiet_right(word, place, place + more)
    return keys


def _posting(keys, rank: dict[str, int]):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = column(batch, "word")
            for start in range(0, len(every), POSTED_WORDS):
                posted, owners = [], []
                for word in every[start:start + POSTED_WORDS]:
                    own = keys(word, rank)
                    posted.extend(xxhash.xxh64_intdigest(k.encode()) - (1 << 63) for k in own)
                    owners.extend([word] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(posted, pa.int64()), pa.array(owners, pa.string())], names=["key", "word"])

    return step


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: all pairs of words of at least ``LEAST_LENGTH`` letters one edit apart, each once.

    Keys travel as 64-bit hashes; every candidate is verified on the words. The table of bigrams, at most one row per pair of
    letters, comes to the driver and goes to every task.
    """
    counted = sorted((r["words"], r["gram"]) for r in bigrams(vocabulary).collect())
    rank = {gram: at for at, (_, gram) in enumerate(counted)}
    only = vocabulary.select("word")
    pivot = arrow_map(only, _posting(pivot_keys, rank), "key long, word string").withColumnRenamed("word", "_left")
    other = arrow_map(only, _posting(prefix_keys, rank), "key long, word string").withColumnRenamed("word", "_right")
    met = pivot.join(other, "key").filter(
        (F.col("_left") != F.col("_right")) & (F.abs(F.length("_left") - F.length("_right")) <= 1)
        & (F.levenshtein("_left", "_right", 1) == 1)
    )
    return met.select(F.least("_left", "_right").alias("a"), F.greatest("_left", "_right").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form; what a word points to is replaced by what that points to, until nothing moves.

    Counts rise tenfold from form to form, so there are no cycles and few rounds.
    """
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = current.join(further, "root", "left")
        if moved.filter(F.col("_further").isNotNull()).isEmpty():
            break
        current = materialize(moved.select("word", F.coalesce("_further", "root").alias("root")), "roots")
    return current


def variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``docs``, columns ``doc_id, text``.

    ``form`` is the near word that stands most often, the smallest in code-point order among several, if it stands at least
    ``FORM_RATIO`` times as often as the word; ``root`` is the last word reached from form to form.

    Null and empty texts hold no words; a null id is the empty text in the deletion rule; repeated rows count again. Texts are
    taken whole; a text of any length is one row whose words are counted before they travel. Other columns are not read. No
    documents, no rows.
    """
    vocabulary = materialize(words(docs), "words")
    pairs = materialize(near_words(vocabulary), "near_words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("_other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("_other"))
    )
    counts = vocabulary.select(F.col("word").alias("_other"), F.col("n").alias("_n"))
    best = both.join(counts, "_other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("_other").alias("other"))).alias("_best")
    )
    often = -F.col("_best.less")
    known = often >= FORM_RATIO * F.col("n")
    formed = materialize(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(known, F.col("_best.other")).alias("form"), F.when(known, often).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
