"""Near duplicates by an inverted join of MinHash coordinates, confirmed on full sets.

A document is the set of its 5-word shingles. Rows with equal sets are one node, with or without an id. A node's signature has
``COORDINATES`` MinHash values; two nodes of similarity 0.75 agree in a coordinate with that probability, and agree in
fewer than ``MATCHES`` of them about once in a million pairs. Nodes are posted under coordinate-value pairs.

Prefix: coordinate-value pairs are ordered from rare to common. Two nodes that agree in ``MATCHES`` coordinates
share one of their ``COORDINATES - MATCHES + 1`` rarest, so each node is posted under those alone, and pairs that a
whole corpus shares, as of a common passage, are skipped unless they fill most of a signature. Within a list, agreement
is counted over all coordinates, and nodes above the threshold are tied to the least of their group. What
is tied so makes clusters; inside them every pair is compared on full sets.

Long lists and large clusters are cut into blocks, and pairs of blocks are dealt out, so no task holds more than two
blocks; what leaves a pair of blocks is one row per node, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER_BYTES, arrow_map, same
from tabloom.llm.components import components
from tabloom.session import materialize

SHINGLE = 5
COORDINATES = 48
MATCHES = 21
LIST_BLOCK = 1_024
CLUSTER_BLOCK = 512
BLOCK_SHINGLES = 1_000_000
SLICE = 4_096
# Similarity 75 in 100, in whole numbers.
PART, WHOLE = 75, 100

# Members of clusters that may be broadcast, some tens of bytes each: their number is counted first.
BROADCAST_MEMBERS = 500_000
# What tells rows apart: the id and two hashes of the text. What tells sets apart: the size and two sums over it.
ROW = ["doc_id", "k1", "k2"]
SET = ["n_shingles", "sum1", "sum2"]

_generator = np.random.default_rng(20240229)
MULTIPLIERS = _generator.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
WORD_FACTORS = _generator.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with all bits depending on each other."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    joined = np.full(count, width, np.uint64)
    for k in range(width):
        joined += hashes[k: k + count] * WORD_FACTORS[k]
    return np.unique(mixed(joined))


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each coordinate, below the coordinate's number."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(found), 8_192):
        part = found[start: start + 8_192]
        least = np.minimum(least, ((part[None, :] * MULTIPLIERS[:, None]) >> np.uint64(32)).min(axis=1))
    return (least | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))).astype(np.int64)


def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sums, keys = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            sizes.append(len(found))
            sums.append((found.sum(dtype=np.uint64), mixed(found + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)))
            keys.append(signature(found) if len(found) else np.empty(0, np.int64))
        sums = np.array(sums, np.uint64).reshape(-1, 2).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(sizes, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.ListArray.from_arrays(offsets, flat)],
            ["doc_id", *ROW[1:], *SET, "keys"],
        )


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with one key from sorted batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        values = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key)))
        start = 0
        for at in range(1, len(values) + 1):
            if at < len(values) and values[at] == values[start]:
                continue
            if current is not None and values[start] != current:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, at - start))
            current, start = values[start], at
    if held:
        yield pa.Table.from_batches(held)


def least_reachable(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id it reaches over a symmetric matrix of links."""
    least = ids.copy()
    np.fill_diagonal(linked, True)
    while True:
        reached = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (reached == least).all():
            return least
        least = reached


def between_blocks(linked: np.ndarray, blocks: np.ndarray, left: int, right: int) -> np.ndarray:
    """Links within the one block or across the two."""
    return linked if left == right else linked & (blocks[:, None] != blocks[None, :])


def similar_sizes(sizes: np.ndarray) -> np.ndarray:
    return WHOLE * np.minimum(sizes[:, None], sizes[None, :]) >= PART * np.maximum(sizes[:, None], sizes[None, :])


def agreeing(rows: pa.Table) -> np.ndarray:
    """Nodes of a list that agree in enough coordinates; ``keys`` holds the coordinates shared with anyone."""
    table = np.empty((rows.num_rows, COORDINATES), np.int64)
    table[:] = -1 - np.arange(rows.num_rows)[:, None]
    for at, keys in enumerate(rows.column("keys").to_pylist()):
        keys = np.array(keys, np.int64)
        table[at, keys >> 32] = keys
    linked = np.empty((len(table), len(table)), bool)
    for start in range(0, len(table), 64):
        linked[start: start + 64] = (table[start: start + 64, None, :] == table[None, :, :]).sum(axis=2) >= MATCHES
    return linked & similar_sizes(rows.column("n").to_numpy())


def confirmed(rows: pa.Table) -> np.ndarray:
    """Nodes of a cluster whose full sets are similar enough."""
    sets = [shingles(t) for t in rows.column("text").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    owner, number = owner[shared], (np.cumsum(counts > 1) - 1)[number[shared]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(number.max(initial=-1)) + 1, SLICE):
        low, high = np.searchsorted(number, [start, start + SLICE])
        there = np.zeros((len(sets), SLICE), np.float32)
        there[owner[low:high], number[low:high] - start] = 1
        both += there @ there.T
    both = np.rint(both).astype(np.int64)
    return WHOLE * both >= PART * (sizes[:, None] + sizes[None, :] - both)


def tied_batches(batches: Iterator[pa.RecordBatch], judge: Callable[[pa.Table], np.ndarray], key: list[str]) -> Iterator[pa.RecordBatch]:
    """``a, b``: nodes tied to the least node they reach within a pair of blocks."""
    for rows in groups(batches, key):
        if rows.num_rows < 2:
            continue
        ids, left, right = rows.column("id").to_numpy(), rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
        linked = between_blocks(judge(rows), rows.column("block").to_numpy(), left, right)
        least = least_reachable(linked, ids)
        moved = least != ids
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(least[moved])], ["a", "b"])


def in_blocks(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Rows dealt to the pairs of blocks of their group: ``left, right, block``; ``blocks`` has the number per key."""
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    dealt = rows.join(blocks, key).withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int")))
    return dealt.withColumn("_other", other).withColumn("left", F.least("block", "_other")).withColumn("right", F.greatest("block", "_other")).drop("_blocks", "_other")


def tied(rows: DataFrame, key: str, judge: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    order = [key, "left", "right"]
    sorted_rows = rows.repartition(*order).sortWithinPartitions(*order)
    return arrow_map(sorted_rows, lambda b: tied_batches(b, judge, order), "a long, b long")


def candidates(nodes: DataFrame) -> DataFrame:
    """``a, b`` ties between nodes ``id, n, keys`` that agree in enough coordinates and share a posting list."""
    posted = nodes.select("id", "n", F.explode("keys").alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("found")).filter("found > 1")
    shared = posted.join(counts, "key").groupBy("id").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("found", "key"))).alias("_shared")
    ).filter(F.size("_shared") >= MATCHES)
    prefix = F.slice("_shared", F.lit(1), F.size("_shared") - (MATCHES - 1))
    lists = materialize(
        shared.select("id", "n", F.transform("_shared", lambda s: s["key"]).alias("keys"), F.transform(prefix, lambda s: s["key"]).alias("_prefix")), "prefixes"
    )
    posts = lists.select(F.explode("_prefix").alias("key"), "id", "n", "keys")
    lengths = lists.select(F.explode("_prefix").alias("key")).groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = lengths.select("key", F.ceil(F.col("_n") / LIST_BLOCK).alias("_blocks"))
    return tied(in_blocks(posts, "key", blocks), "key", agreeing)


def links(clusters: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b`` ties between nodes of one cluster whose sets are similar enough.

    Each node is read from one row, the one named in ``first``; copies of that row come down to one before they travel.
    """
    members = materialize(clusters.join(nodes.select("id", "n", "first"), "id"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("_n"), F.sum("n").alias("_s"))
    blocks = sizes.select("component", F.greatest(F.ceil(F.col("_n") / CLUSTER_BLOCK), F.ceil(F.col("_s") / BLOCK_SHINGLES)).alias("_blocks"))
    read = members.select("id", "component", *[F.col(f"first.{c}").alias(f"_{c}") for c in ROW])
    # The members grow with the corpus, so they are broadcast only while they are few.
    read = F.broadcast(read) if members.count() <= BROADCAST_MEMBERS else read.hint("merge")
    met = rows.join(read, (rows["k1"] == read["_k1"]) & (rows["k2"] == read["_k2"]) & same(rows["doc_id"], read["_doc_id"]))
    texts = met.groupBy("id").agg(F.first("component").alias("component"), F.first("text").alias("text"))
    return tied(in_blocks(texts, "component", blocks), "component", confirmed)


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, node, component_id`` per row: its group, and the least id in it.

    Every distinct set is a node of its own, numbered by a hash of its size and sums, whatever the ids of its rows. Rows without
    shingles have no node, and groups without an id no component.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("k1"), F.hash(body).alias("k2"))
    schema = "doc_id long, k1 long, k2 int, n_shingles long, sum1 long, sum2 long, keys array<long>"
    signed = materialize(arrow_map(rows, sign_batches, schema), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *ROW)).alias("first")
    sets = signed.filter("n_shingles > 0").groupBy(*SET).agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), first)
    nodes = materialize(sets.select(F.xxhash64(*SET).alias("id"), F.col("n_shingles").alias("n"), *SET, "keys", "least", "first"), "nodes")
    clusters = materialize(components(candidates(nodes)), "clusters")
    found = components(links(clusters, nodes, rows))
    placed = nodes.select("id", *SET, "least").join(found, "id", "left").withColumn("node", F.coalesce("component", "id"))
    leasts = placed.groupBy("node").agg(F.min("least").alias("component_id"))
    named = placed.select(*SET, "node").join(leasts, "node")
    return signed.select(*ROW, *SET).join(named, SET, "left").select(*ROW, "n_shingles", "node", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows without an id are linked as
    others are; they take the least id of their group and are kept only if it has none. Rows that share an id are each
    judged by their own text; repeated rows are in one group. Long texts are whole rows; ties of ids do not matter. Other columns are
    not read. An empty table gives no rows.
    """
    rows = grouped(docs)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs``, as it is: the one of the least id, of these the one of the least text hashes.

    Rows without an id come after those with one. Of rows equal in id and text one stays, whatever their other columns hold. Rows
    without shingles are in no group and all stay. Whole rows are met by the keys of those that go, which are few.
    """
    rows = materialize(grouped(docs).filter("n_shingles > 0").groupBy("node", *ROW).agg(F.count("*").alias("copies")), "grouped")
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *ROW)).alias("_first"))
    mine = (F.col("k1") == F.col("_first.k1")) & (F.col("k2") == F.col("_first.k2")) & same(F.col("doc_id"), F.col("_first.doc_id"))
    marked = rows.join(first, "node").select(*[F.col(c).alias(f"_near_{c}") for c in ROW], (mine & (F.col("copies") > 1)).alias("_near_many"), mine.alias("_near_first"))
    gone = materialize(marked.filter("_near_many or not _near_first").drop("_near_first"), "gone")

    def met(keys: DataFrame) -> Column:
        body = F.coalesce(docs["text"].cast("string"), F.lit(""))
        return (F.xxhash64(body) == keys["_near_k1"]) & (F.hash(body) == keys["_near_k2"]) & same(docs["doc_id"].cast("long"), keys["_near_doc_id"])

    left = docs.join(gone, met(gone), "left_anti")
    many = gone.filter("_near_many")
    if many.isEmpty():
        return left
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_near_row")
    copies = docs.join(many, met(many)).select(whole, *[f"_near_{c}" for c in ROW])
    once = copies.groupBy(*[f"_near_{c}" for c in ROW]).agg(F.first("_near_row").alias("_near_row"))
    return left.unionByName(once.select("_near_row.*"))
