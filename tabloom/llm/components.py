"""Connected components of an edge table by alternating stars, one stored edge table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))), F.lit(0))).first()
    return tuple(found)


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node of the edges ``a, b``: the least node that can be reached from it.

    Each round is a few joins and aggregations by node that combine before their shuffle; what comes to the
    driver is one row that tells whether a round changed anything.
    """
    larger = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Stored first: a round reads its edges several times, and these may be costly to make.
    current = materialize(_small_star(materialize(larger.distinct(), "edges")), "edges")
    state = _state(current)
    while state[0]:
        following = materialize(_small_star(_large_star(current).filter(F.col("a") != F.col("b")).distinct()), "edges")
        now = _state(following)
        current = following
        if now == state:
            break
        state = now
    # Stars by now: every node hangs on the least one of its component.
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
