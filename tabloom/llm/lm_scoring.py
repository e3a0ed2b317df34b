"""Scoring of texts by a probabilistic suffix tree learned from the corpus.

One pass over the training texts counts words and byte sequences in each partition; the counts meet in a
shuffle. The sequences of ``DEPTH`` bytes and a next byte give the counts of all shorter contexts, rare ones included. A
divergence test that weighs counts decides which contexts make the tree. A text is read as its
words with blanks between and an end: its probability is the product over the bytes, each after the longest
context in the tree. That is a distribution over sequences of words.

Every task gets the most frequent contexts of the tree. Where one of the others may be longer, which a bit map of fixed size
tells, the score of a byte is corrected by what those contexts change after the bytes before it. The most frequent of
these sequences go to every task with their change; the others leave their text and meet the contexts in joins. So scores are
those of the whole tree, however large it is.

For the base, the counts of words above a share of all tokens go to every task, again few by that rule; the other words
of each text leave it with their number and meet their counts in a join by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER_BYTES, arrow_map, column, pieces, starts_of
from tabloom.llm.suffix_tree import DEPTH, DISCOUNT, SuffixAutomaton, distributions
from tabloom.session import materialize

END = b"\n"
HELD_OUT, PARTS = 0, 10
# Nats by which a context makes its next bytes likelier in all, and how many contexts of the tree go to every task.
LEAST_GAIN = 4.0
MOST_CONTEXTS = 40_000
# Bits of the map of the other contexts, in words of 64; a prime, as places are remainders.
MAP_BITS = 67_108_859
# Sequences whose change goes to every task, 16 bytes each; how finely their counts are told apart to find the most frequent.
MOST_SEQUENCES = 1_500_000
STEPS_PER_DOUBLING = 4
LEAST_WORD = 5e-7
TEXT_BLOCK = 3_000_000
SCORED_BLOCK = 750_000
COUNTED_WORDS = 300_000
STRETCH = 256
# Rows that leave a Python worker at once.
ROWS = 100_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_BYTES).split()


def held_out(doc: int | None) -> bool:
    """A tenth of the ids by checksum; rows without an id are held out."""
    return doc is None or zlib.crc32(str(doc).encode()) % PARTS == HELD_OUT


def stream_of(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one byte stream, each after ``DEPTH`` ends; where each begins and how long it is with its end."""
    bodies = [b" ".join(words) + END for words in lists]
    stream = np.frombuffer(b"".join(END * DEPTH + body for body in bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    return stream, starts_of(len(b) + DEPTH for b in bodies)[:-1] + DEPTH, sizes


def packed_of(stream: np.ndarray) -> np.ndarray:
    """Every byte from place ``DEPTH`` on, packed with the ``DEPTH`` bytes before it."""
    packed = np.zeros(len(stream) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        packed = packed << 8 | stream[k: len(stream) - DEPTH + k]
    return packed


def sequences(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Packed sequences of ``DEPTH`` bytes and the next, with their counts."""
    stream, begin, sizes = stream_of(lists)
    inside = np.ones(len(stream), bool)
    for k in range(1, DEPTH + 1):
        inside[begin - k] = False
    return np.unique(packed_of(stream)[inside[DEPTH:]], return_counts=True)


def in_rows(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows."""
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def count_rows(words: Counter, packed: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["word", "packed", "n"]
    yield from in_rows([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())], names)
    yield from in_rows([pa.nulls(len(packed), pa.binary()), pa.array(packed), pa.array(counts.astype(np.int64))], names)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and byte sequences of the training texts of a partition."""
    words, parts = Counter(), []
    for batch in batches:
        texts = [t for d, t in zip(column(batch, "doc_id"), column(batch, "text")) if not held_out(d)]
        for start, end in pieces(texts, TEXT_BLOCK):
            lists = [words_of(t) for t in texts[start:end]]
            for one in lists:
                words.update(one)
            words[END] += len(lists)
            parts.append(sequences(lists))
            if len(words) > COUNTED_WORDS or len(parts) >= 8:
                yield from count_rows(words, *merged(parts))
                words, parts = Counter(), []
    yield from count_rows(words, *merged(parts))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values, number = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return values, np.bincount(number, np.concatenate([c for _, c in parts])).astype(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``word, packed, n``: the stored counts of words (``packed`` null) and of sequences (``word`` null)."""
    rows = arrow_map(docs, count_batches, "word binary, packed long, n long")
    return materialize(rows.groupBy("word", "packed").agg(F.sum("n").alias("n")), "corpus-counts")


def _shorter(context: str, length: str) -> Column:
    """The last ``length`` bytes of a packed context."""
    return F.col(context).bitwiseAND(F.expr(f"shiftleft(1L, 8 * {length}) - 1"))


def context_counts(counts: DataFrame) -> DataFrame:
    """``length, context, symbol, n, total``, stored: every context up to ``DEPTH`` bytes and every byte after it.

    A context has 256 bytes after it at most, so its window is as small.
    """
    lengths = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("length")
    exploded = counts.filter("packed is not null").select("n", lengths, F.shiftright("packed", 8).alias("before"), F.col("packed").bitwiseAND(F.lit(255)).alias("symbol"))
    pairs = exploded.groupBy("length", _shorter("before", "length").alias("context"), "symbol").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("length", "context")
    return materialize(pairs.withColumn("total", F.sum("n").over(whole)), "contexts")


def kept_contexts(pairs: DataFrame, least_gain: float) -> DataFrame:
    """``length, context, total, kinds``, stored: contexts whose next bytes diverge significantly from what the context one byte
    shorter says, and their suffixes, with their counts and numbers of different next bytes.

    The test weighs the divergence with the count: a context stays if its bytes become likelier by ``least_gain`` nats in all, however
    rare it is.
    """
    parents = pairs.select(
        (F.col("length") + 1).alias("length"), F.col("context").alias("_parent"), "symbol", (F.col("n") / F.col("total")).alias("_before")
    )
    children = pairs.filter("length > 0").withColumn("_parent", _shorter("context", "(length - 1)"))
    share = F.col("n") / F.col("total")
    gains = children.join(parents, ["length", "_parent", "symbol"]).groupBy("length", "context").agg(
        F.sum(F.col("n") * F.log(share / F.col("_before"))).alias("gain")
    )
    wanted = gains.filter(F.col("gain") >= least_gain)
    suffixes = F.explode(F.sequence(F.lit(1), F.col("length"))).alias("_size")
    every = wanted.select("context", suffixes).select(F.col("_size").alias("length"), _shorter("context", "_size").alias("context")).distinct()
    kept = pairs.join(every, ["length", "context"]).groupBy("length", "context").agg(F.first("total").alias("total"), F.count("*").alias("kinds"))
    return materialize(kept, "kept-contexts")


def split_tree(counts: DataFrame, least_gain: float, most: int) -> tuple[SuffixAutomaton, DataFrame | None, DataFrame]:
    """The ``most`` most frequent contexts of the tree as an automaton, the other ones or None, and the counts of all pairs.

    Counts, tests and the choice of contexts are joins over all of them. No context is more frequent than its suffixes, so those chosen
    bring theirs along; they come to the driver with the bytes after them.
    """
    pairs = context_counts(counts)
    kept = kept_contexts(pairs, least_gain)
    near, rest = kept, None
    if kept.count() > most:
        near = materialize(kept.orderBy(F.desc("total"), "length", "context").limit(most), "near-contexts")
        rest = materialize(kept.join(near, ["length", "context"], "left_anti"), "far-contexts")
    table = pairs.filter("length = 0").unionByName(pairs.join(near, ["length", "context"], "left_semi")).toArrow()
    columns = [table.column(c).to_numpy() for c in ("length", "context", "symbol", "n", "total")]
    return SuffixAutomaton(*distributions(*columns)), rest, pairs


def context_map(rest: DataFrame) -> np.ndarray:
    """A bit at the place of every context of ``rest``; others may share it. It comes to the driver as words that are not 0."""
    place = F.pmod(F.shiftleft("context", 3) + F.col("length"), F.lit(MAP_BITS))
    words = rest.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")
    ).toArrow()
    found = np.zeros((MAP_BITS >> 6) + 1, np.int64)
    found[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return found


def may_be_longer(packed: np.ndarray, depth: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the map has the context one byte longer than the one that was found; the tree holds all suffixes of its contexts."""
    place = ((packed >> 8 & (1 << 8 * (depth + 1)) - 1) << 3 | depth + 1) % MAP_BITS
    return (known[place >> 6] >> (place & 63) & 1).astype(bool)


def left_open(stream: np.ndarray, begin: np.ndarray, depths: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and packed sequence of every place that may have a longer context than the automaton's."""
    at = np.flatnonzero(depths < DEPTH)
    packed = packed_of(stream)[at - DEPTH]
    open_ = may_be_longer(packed, depths[at].astype(np.int64), known)
    at, packed = at[open_], packed[open_]
    return np.repeat(np.arange(len(begin)), np.diff(np.append(np.searchsorted(at, begin), len(at)))), packed


def settled(text: np.ndarray, packed: np.ndarray, texts: int, changing: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What known changes add to the score of each text; the text, sequence and number of the others, each once.

    Changes are looked up once for each distinct sequence.
    """
    codes, number = np.unique(packed, return_inverse=True)
    place = np.minimum(np.searchsorted(changing, codes), max(0, len(changing) - 1))
    met = changing[place] == codes if len(changing) else np.zeros(len(codes), bool)
    values = np.zeros(len(codes))
    values[met] = change[place[met]]
    added = np.bincount(text, values[number], texts)
    rest = ~met[number]
    both, times = np.unique(text[rest] * max(1, len(codes)) + number[rest], return_counts=True)
    return added, both // max(1, len(codes)), codes[both % max(1, len(codes))], times


def corrections(found: DataFrame, rest: DataFrame, pairs: DataFrame) -> DataFrame:
    """``packed, change``: by how much the contexts of ``rest`` change the scores of distinct sequences.

    Each of them on the way from the context that was found to the longest one passes on what its discounts free, as in the tree.
    """
    once = found.groupBy("packed").agg(F.first("depth").alias("depth"), F.first("small").alias("small"))
    lengths = F.explode(F.sequence(F.col("depth") + 1, F.lit(DEPTH))).alias("length")
    ways = once.select("packed", "small", F.shiftright("packed", 8).alias("_before"), F.col("packed").bitwiseAND(F.lit(255)).alias("symbol"), lengths)
    ways = ways.withColumn("context", _shorter("_before", "length")).drop("_before").join(rest, ["length", "context"])
    seen = ways.join(pairs.select("length", "context", "symbol", "n"), ["length", "context", "symbol"], "left")
    chain = seen.groupBy("packed").agg(F.first("small").alias("small"), F.sort_array(F.collect_list(F.struct("length", "n", "total", "kinds"))).alias("chain"))
    longer = F.aggregate(
        "chain", F.pow(F.lit(10.0), F.col("small")),
        lambda p, c: F.coalesce(c["n"] - F.lit(DISCOUNT), F.lit(0.0)) / c["total"] + F.lit(DISCOUNT) * c["kinds"] / c["total"] * p,
    )
    return chain.select("packed", (F.log10(longer) - F.col("small")).alias("change"))


def open_sequences(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Those of counted sequences that the automaton leaves open."""
    automaton, longer = model.value
    for batch in batches:
        packed = batch.column(0).to_numpy()
        depth, small = automaton.after(packed)
        kept = np.flatnonzero(depth < DEPTH)
        kept = kept[may_be_longer(packed[kept], depth[kept].astype(np.int64), longer)]
        yield pa.RecordBatch.from_arrays([
            pa.array(packed[kept]), batch.column(1).take(pa.array(kept)), pa.array(depth[kept].astype(np.int32)), pa.array(small[kept].astype(np.float64)),
        ], ["packed", "n", "depth", "small"])


def frequent_changes(counts: DataFrame, model, rest: DataFrame, pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the open sequences of the training texts, the most frequent ones, in order, and what changes their scores."""
    rows = arrow_map(counts.filter("packed is not null").select("packed", "n"), lambda b: open_sequences(b, model), "packed long, n long, depth int, small double")
    rows = materialize(rows.withColumn("_step", F.floor(F.log2("n") * STEPS_PER_DOUBLING)), "open-sequences")
    # A row per step of the counts: their number grows with the logarithm of the corpus.
    steps, held, least = rows.groupBy("_step").count().orderBy(F.desc("_step")).collect(), 0, None
    for step, size in steps:
        held += size
        if held > most:
            break
        least = step
    if least is None:
        return np.empty(0, np.int64), np.empty(0)
    found = corrections(rows.filter(F.col("_step") >= least), rest, pairs).toArrow()
    packed = found.column("packed").to_numpy()
    order = np.argsort(packed)
    return packed[order], found.column("change").to_numpy()[order]


def scored_batches(batches: Iterator[pa.RecordBatch], model, changes, common) -> Iterator[pa.RecordBatch]:
    """A row per text, one per text and word that is not common, and one per text and open sequence whose change is not known."""
    (automaton, longer), (changing, change), known, row = model.value, changes.value, common.value, TaskContext.get().partitionId() << 36
    for batch in batches:
        ids, texts = column(batch, "doc_id"), column(batch, "text")
        for start, end in pieces(texts, SCORED_BLOCK):
            lists = [words_of(t) for t in texts[start:end]]
            stream, begin, sizes = stream_of(lists)
            parts = -(-sizes // STRETCH)
            text = np.repeat(np.arange(len(lists)), parts)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
            depths = None if longer is None else np.full(len(stream), DEPTH, np.int8)
            scores = automaton.score(stream, begin[text] + nth * STRETCH, np.minimum(STRETCH, sizes[text] - nth * STRETCH), depths)
            scores = np.bincount(text, scores, len(lists))
            if longer is not None:
                added, of, packed, held = settled(*left_open(stream, begin, depths, longer), len(lists), changing, change)
                scores = scores + added
            bases, found, rest = [], [], ([], [], [])
            for n, words in enumerate(lists):
                base, hits = known.get(END, 0.0), int(END in known)
                if END not in known:
                    rest[0].append(row + n), rest[1].append(END), rest[2].append(1)
                for word, times in Counter(words).items():
                    value = known.get(word)
                    if value is None:
                        rest[0].append(row + n), rest[1].append(word), rest[2].append(times)
                    else:
                        base += value * times
                        hits += times
                bases.append(base), found.append(hits)
            size, more = len(lists), len(rest[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + size)), pa.array(ids[start:end], pa.int64()), pa.array([held_out(d) for d in ids[start:end]]),
                pa.array([len(w) + 1 for w in lists], pa.int64()), pa.array(found, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores),
                pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64()), *nothing(size),
            ], SCORED)
            yield from in_rows([
                pa.array(rest[0], pa.int64()), pa.nulls(more, pa.int64()), pa.nulls(more, pa.bool_()), pa.nulls(more, pa.int64()),
                pa.nulls(more, pa.int64()), pa.nulls(more, pa.float64()), pa.nulls(more, pa.float64()),
                pa.array(rest[1], pa.binary()), pa.array(rest[2], pa.int64()), *nothing(more),
            ], SCORED)
            if longer is not None:
                depth, small = automaton.after(packed)
                yield from in_rows([
                    pa.array(of + row), *(pa.nulls(len(of), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())),
                    pa.array(held.astype(np.int64)), pa.array(packed), pa.array(depth.astype(np.int32)), pa.array(small.astype(np.float64)),
                ], SCORED)
            row += size


def nothing(size: int) -> list[pa.Array]:
    """The columns of sequences in rows of texts and words."""
    return [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.float64())]


SCORED = ["row", "doc_id", "held_out", "n_tokens", "found", "base", "score", "word", "times", "packed", "depth", "small"]
SCORED_TYPES = (
    "row long, doc_id long, held_out boolean, n_tokens long, found long, base double, score double, word binary, times long,"
    " packed long, depth int, small double"
)
SALTS = 4_096


def score_documents(
    docs: DataFrame, least_gain: float = LEAST_GAIN, most: int = MOST_CONTEXTS, most_sequences: int = MOST_SEQUENCES
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Null and empty texts are the end alone; rows without an id are scored but not learned from; repeated rows
    count and are scored each; without training rows all words have the same probability; an empty table
    gives no rows. ``most`` and ``most_sequences`` bound what goes to
    every task, not what counts.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = corpus_counts(narrow)
    words = counts.filter("word is not null").select("word", "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    under = tokens + 0.1 * (kinds + 1)
    value = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(under))
    limit = max(1.0, LEAST_WORD * tokens)
    # At most 1 / LEAST_WORD words, however large the corpus.
    often = words.filter(F.col("n") >= limit).select("word", value.alias("value")).toArrow()
    common = spark.sparkContext.broadcast(dict(zip(often.column("word").to_pylist(), often.column("value").to_pylist())))
    automaton, rest, pairs = split_tree(counts, least_gain, most)
    model = spark.sparkContext.broadcast((automaton, None if rest is None else context_map(rest)))
    changes = (np.empty(0, np.int64), np.empty(0)) if rest is None else frequent_changes(counts, model, rest, pairs, most_sequences)
    changes = spark.sparkContext.broadcast(changes)
    rows = arrow_map(narrow, lambda b: scored_batches(b, model, changes, common), SCORED_TYPES)
    if rest is not None:
        rows = materialize(rows, "scored")
    found, rows = rows.filter("packed is not null").select("row", "times", "packed", "depth", "small"), rows.filter("packed is null")
    # Rows of texts have no word to look up; a key with a line break is no word, and many of them spread the rows.
    key = F.coalesce("word", F.concat(F.lit("\n"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("string")).cast("binary"))
    rare = words.filter(F.col("n") < limit).select(F.col("word").alias("_w"), "n")
    joined = rows.withColumn("_key", key).join(rare, F.col("_key") == F.col("_w"), "left").select(
        "row", "doc_id", "held_out", "n_tokens", F.col("word").isNull().alias("_text"), "score",
        F.when(F.col("word").isNull(), F.col("found")).otherwise(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
        F.when(F.col("word").isNull(), F.col("base")).otherwise(value * F.col("times")).alias("base"),
    )
    if rest is not None:
        others = found.join(corrections(found, rest, pairs), "packed").select("row", (F.col("times") * F.col("change")).alias("score"))
        joined = joined.unionByName(others.withColumns({"found": F.lit(0).cast("long"), "base": F.lit(0.0)}), allowMissingColumns=True)
    whole = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("found").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
