"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of consecutive words. Over the whole corpus the words of the windows are counted;
a window with a word that the corpus lacks cannot occur as it is, but its other words may stand near each other. The
postings (text, word, position) of the two rarest words of each window that the corpus has are stored, and intersected
after taking off each word's offset in the window. Where both lists agree on a start, the whole window is compared with
the text, so matches are exact. Where the two words only stand near each other, the window counts as a proximity match.
A text that lacks one of these two words, which others have, is not near.

Texts are known by two hashes of the text, so copies have one entry in the index; a collision could only
add places to compare. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabloom.llm.common import plain_words
from tabloom.session import materialize

WINDOW = 10
SLOP = 5
RARE = 2
# Terms that may be broadcast: their number is counted first, and more of them are joined by shuffle.
BROADCAST_TERMS = 500_000
# Texts with claimed windows whose first hash may be broadcast, counted first as well.
BROADCAST_TEXTS = 2_000_000
KEY = ("_k1", "_k2")


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``_text`` with its two hashes."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select("*", body.alias("_text"), F.xxhash64(body).alias("_k1"), F.hash(body).alias("_k2"))


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """``win, terms, items, unnamed``: distinct windows with the items they occur in, and whether one of these has no id.

    Items without words have none.
    """
    listed = benchmark.select(F.col(item).cast("string").alias("item"), plain_words(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - size, F.lit(0)))).alias("_first")
    cut = listed.select("item", "_words", starts).select("item", F.slice("_words", F.col("_first") + 1, size).alias("terms"))
    named = cut.groupBy("terms").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))
    return named.select(F.xxhash64("terms").alias("win"), "terms", "items", "unnamed")


def small(terms: DataFrame) -> DataFrame:
    """Terms marked for broadcast if they are few."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def rarest(wins: DataFrame, texts: DataFrame) -> DataFrame:
    """``win, term, offset, rank, needed, possible``: the rarest words of each window among those that the corpus has.

    A window is possible if the corpus has all its words; others can only be near.
    """
    offsets = wins.select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    vocabulary = materialize(offsets.select("term").distinct(), "benchmark-terms")
    words = texts.select(F.explode(plain_words(F.col("_text"))).alias("term"))
    counts = words.join(small(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("found"))
    chosen = offsets.join(counts, "term").groupBy("win").agg(
        F.first("size").alias("size"), F.count("*").alias("_here"),
        F.slice(F.sort_array(F.collect_list(F.struct("found", "offset", "term"))), 1, RARE).alias("_rare"),
    ).withColumn("possible", F.col("_here") == F.col("size")).filter(F.col("possible") | (F.size("_rare") > 1))
    return chosen.select("win", "possible", F.size("_rare").alias("needed"), F.posexplode("_rare").alias("rank", "_r")).select(
        "win", "needed", "possible", "rank", F.col("_r.term").alias("term"), F.col("_r.offset").alias("offset")
    )


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: ``term`` with the texts and positions where it stands."""
    words = texts.select(*KEY, F.posexplode(plain_words(F.col("_text"))).alias("pos", "term"))
    return materialize(words.join(small(terms), "term", "left_semi"), "postings")


def claimed(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """The texts that may have claims: a broadcast of hashes leaves out the others before texts move, if claimed ones are few.

    What it leaves is stored, as Spark loses a column where this join and the next one are planned as one.
    """
    if claims.count() > BROADCAST_TEXTS:
        return texts
    return materialize(texts.join(F.broadcast(claims.select("_k1")), "_k1", "left_semi"), "claimed-texts")


def covered(spans: Column) -> Column:
    """Positions inside any of the sorted ``start, end`` spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], s["end"]).alias("to"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"].cast("long"))


def located(docs: DataFrame, benchmark: DataFrame, size: int, slop: int, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows; texts with the places of their exact windows, ``_true``; and ``_k1, _k2, win, start`` of windows only near."""
    texts = keyed(docs.select(F.col(text)), text)
    wins = materialize(windows(benchmark, size), "benchmark-windows")
    rare = materialize(rarest(wins, texts), "rarest-terms")
    index = postings(texts, rare.select("term").distinct())
    places = index.join(rare, "term").select(*KEY, "win", "needed", "possible", "rank", (F.col("pos") - F.col("offset")).alias("start"))
    places = materialize(places.distinct(), "placed-windows")
    agreed = places.filter("possible").groupBy(*KEY, "win", "start").agg(F.count("*").alias("_n"), F.first("needed").alias("needed"))
    agreed = agreed.filter((F.col("_n") == F.col("needed")) & (F.col("start") >= 0))
    claims = agreed.join(wins.select("win", "terms"), "win").groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.size("terms")).alias("end"), "win", "terms"))).alias("_claims")
    )
    claims = materialize(claims, "claims")
    whole = claimed(texts.select(*KEY, "_text"), claims).join(claims, list(KEY)).withColumn("_words", plain_words(F.col("_text")))
    true = F.filter("_claims", lambda c: F.slice(F.col("_words"), c["start"] + 1, F.size(c["terms"])) == c["terms"])
    exact = whole.select(*KEY, F.transform(true, lambda c: F.struct(c["start"], c["end"], c["win"])).alias("_true"))
    exact = materialize(exact.filter(F.size("_true") > 0).dropDuplicates(list(KEY)), "exact-windows")
    own = Window.partitionBy(*KEY, "win").orderBy("start", "rank")
    near = places.filter("needed > 1").withColumn("_before", F.lag("start").over(own)).withColumn("_other", F.lag("rank").over(own) != F.col("rank"))
    near = near.filter(F.col("_other") & (F.col("start") - F.col("_before") <= slop)).select(*KEY, "win", F.greatest("_before", F.lit(0)).alias("start"))
    found = exact.select(*KEY, F.explode(F.array_distinct(F.transform("_true", lambda c: c["win"]))).alias("win"))
    return wins, exact, near.distinct().join(found, [*KEY, "win"], "left_anti")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, text: str = "text") -> DataFrame:
    """``_k1, _k2, n_hit, items, unnamed, n_near`` for every text with a phrase or proximity match.

    ``items`` are the sorted ids of the items with an exact window, ``unnamed`` tells whether an item without an id has
    one, and ``n_near`` is the number of windows that are only near.
    """
    wins, exact, near = located(docs, benchmark, size, slop, text)
    found = exact.select(*KEY, F.explode(F.array_distinct(F.transform("_true", lambda c: c["win"]))).alias("win"))
    items = found.join(wins.select("win", F.explode_outer("items").alias("item"), "unnamed"), "win").groupBy(*KEY).agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max("unnamed").alias("unnamed")
    )
    phrases = exact.select(*KEY, covered(F.col("_true")).alias("n_hit")).join(items, list(KEY))
    near = near.select(*KEY, "win").distinct().groupBy(*KEY).agg(F.count("*").alias("n_near"))
    return phrases.join(near, list(KEY), "full").select(
        *KEY, F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("unnamed", F.lit(False)).alias("unnamed"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def places(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """``doc_id, item, start, kind``: every match of a row of ``docs``, ``exact`` or ``near``, with the word it starts at.

    A match of a window that several items share is a row for each; items without an id have a null item. A near window
    starts where the earlier of its two rarest words puts it, at 0 at least.
    """
    wins, exact, near = located(docs, benchmark, size, slop, "text")
    both = exact.select(*KEY, F.explode("_true").alias("_c")).select(*KEY, "_c.win", "_c.start", F.lit("exact").alias("kind"))
    both = both.unionByName(near.withColumn("kind", F.lit("near")))
    listed = F.explode(F.when(F.col("unnamed"), F.concat("items", F.array(F.lit(None).cast("string")))).otherwise(F.col("items"))).alias("item")
    rows = both.join(wins.select("win", listed), "win").select(*KEY, "item", "start", "kind").distinct()
    return keyed(docs.select("doc_id", "text"), "text").select("doc_id", *KEY).join(rows, list(KEY)).select("doc_id", "item", "start", "kind")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` for every row of ``docs``.

    Null and empty texts and items have no words, and nothing matches them; null ids pass through; repeated rows
    are reported each; an empty table gives no rows, and an empty benchmark leaves every row clean. Items without an
    id are matched as others are; together they count as one item, which has no part in the digest.
    """
    found = materialize(matches(docs, benchmark, size, slop), "matches")
    rows = keyed(docs.select("doc_id", "text"), "text").select("doc_id", *KEY, F.size(plain_words(F.col("_text"))).cast("long").alias("n_words"))
    joined = rows.join(found, list(KEY), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"), (F.size(items) + F.coalesce("unnamed", F.lit(False)).cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, as they are."""
    found = materialize(matches(docs, benchmark, size, text=text).filter("n_hit > 0").select(*KEY), "contaminated")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = (F.xxhash64(body) == found["_k1"]) & (F.hash(body) == found["_k2"])
    return docs.join(found, same, "left_anti")
