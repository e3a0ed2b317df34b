"""Fixed virtual slots: records hash into slots for good, and a versioned map says which shard holds a slot.

A record's slot depends on its key and the number of slots alone. The first map and every map grown by
one shard depend on the number of slots and shards alone, so the law is ``key``: growing moves slots,
and with them rows, only into the new shard. ``rebalanced`` is the other edit, which moves slots by their
stored bytes; a map edited so no longer follows from the number of shards.

Maps hold one row per slot. Their size is bounded by ``slots``, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import same
from tabloom.session import materialize, work_path

SLOTS = 4_096
ROW_BYTES = 16
# Rows of a slot are numbered in this many parts, so that a key of very many rows, such as null, is spread over tasks.
PARTS = 64
# Repeated rows that are numbered together.
CHUNK = 10_000


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null keys share one slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """``vslot, shard`` with slots dealt out in turn."""
    return spark.range(0, slots, 1, 1).select(
        F.col("id").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def grown(slot_map: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map for one shard more than ``shards``: each shard hands over the slots above its new share."""
    share = -(-slots // (shards + 1))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot"))
    return slot_map.withColumn("_rank", rank).select(
        *[c for c in slot_map.columns if c != "shard"],
        F.when(F.col("_rank") > share, shards).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def rebalanced(slot_map: DataFrame) -> DataFrame:
    """The map ``vslot, shard, bytes`` with surplus slots moved to shards below the mean.

    Each shard keeps its largest slots as long as they fit the mean; the rest are laid end to end against
    the free room of the other shards. A slot larger than the mean stays where it is. All windows run
    over one row per slot or shard.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(slot_map.select("shard").distinct().count())
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    placed = slot_map.withColumn("_mean", mean).withColumn("_held", held).withColumn(
        "_stays", (F.col("_held") <= F.col("_mean")) | (F.col("_held") == F.col("bytes"))
    )
    kept = F.coalesce(F.sum(F.when(F.col("_stays"), F.col("bytes"))), F.lit(0))
    room = placed.groupBy("shard").agg(F.greatest(F.first("_mean") - kept, F.lit(0.0)).alias("_room"))
    spot = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    room = room.withColumn("_at", F.coalesce(F.sum("_room").over(spot), F.lit(0.0))).filter("_room > 0")
    before = Window.orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, -1)
    moving = placed.filter(~F.col("_stays")).withColumn("_at", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("double"))
    both = moving.select("vslot", "bytes", F.col("shard").alias("_old"), "_at", F.lit(None).cast("int").alias("_new")).unionByName(
        room.select(
            F.lit(None).cast("long").alias("vslot"), F.lit(None).cast("long").alias("bytes"),
            F.lit(None).cast("int").alias("_old"), "_at", F.col("shard").alias("_new"),
        )
    )
    # A slot goes to the last shard whose room starts at or before it.
    here = F.last("_new", ignorenulls=True).over(Window.orderBy("_at", F.col("vslot").asc_nulls_first()))
    moved = both.withColumn("_to", here).filter("vslot is not null").select(
        "vslot", F.coalesce("_to", "_old").cast("int").alias("shard"), "bytes"
    )
    return placed.filter("_stays").select("vslot", "shard", "bytes").unionByName(moved)


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``<key>, size, text_crc32, vslot, copies``: rows that agree in all of these are counted, not repeated.

    Null text counts as empty. Counting before the shuffle keeps one row repeated a third of the table from
    meeting in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), slot_of(F.col(key), slots).alias("vslot"),
    )
    return rows.groupBy(key, "size", "text_crc32", "vslot").agg(F.count("*").alias("copies"))


def store_map(slot_map: DataFrame, stats: DataFrame, path: str, version: int) -> None:
    """Add a version to the stored map, with what each slot holds."""
    loads = slot_map.join(F.broadcast(stats), "vslot", "left")
    loads.select(
        F.col("vslot"), F.col("shard"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``<key>, size, text_crc32, law, shard, slot, grown_shard, vslot`` for every row.

    ``slot`` numbers the rows of a shard from 0 without gaps: the virtual slots of a shard follow each
    other, the ``PARTS`` parts of a slot, by a hash of size and checksum, follow each other within it, and rows follow in the order of
    key, size and checksum within theirs. Null keys and null
    texts count as such and as empty; repeated rows get a number each; an empty table gives no rows. Of texts, long ones too, only
    size and checksum travel. Other columns are not read.
    """
    spark = docs.sparkSession
    counted = materialize(sizes(docs, key, text, slots), "slot-rows")
    # One row per slot: bounded by ``slots``.
    stats = counted.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    stats = materialize(stats, "slot-bytes")
    path = work_path(spark, "slot-map")
    store_map(first_map(spark, shards, slots), stats, path, 1)
    store_map(grown(read_map(spark, path, 1).drop("bytes", "rows"), shards, slots), stats, path, 2)
    now, later = read_map(spark, path, 1), read_map(spark, path, 2).select("vslot", F.col("shard").alias("grown_shard"))
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = now.withColumn("_offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(F.broadcast(later), "vslot")
    # One row per part: bounded by ``slots`` times ``PARTS``.
    part = F.pmod(F.xxhash64("size", "text_crc32"), F.lit(PARTS)).alias("_part")
    parted = counted.select("*", part)
    before = Window.partitionBy("_v").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    held = parted.groupBy(F.col("vslot").alias("_v"), F.col("_part").alias("_p")).agg(F.sum("copies").alias("_rows"))
    starts = held.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    starts = starts.join(F.broadcast(places.select(F.col("vslot").alias("_v"), "shard", "grown_shard", "_offset")), "_v")
    within = Window.partitionBy("vslot", "_part").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    placed = parted.withColumn("_end", F.sum("copies").over(within)).join(
        F.broadcast(starts), same(F.col("vslot"), F.col("_v")) & same(F.col("_part"), F.col("_p"))
    )
    first = F.col("_offset") + F.col("_start") + F.col("_end") - F.col("copies")
    chunks = placed.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard", "vslot", (first + F.col("copies") - 1).alias("_last"),
        F.explode(F.sequence(first, first + F.col("copies") - 1, F.lit(CHUNK).cast("long"))).alias("_first"),
    )
    return chunks.select(
        *[c for c in chunks.columns if not c.startswith("_")],
        F.explode(F.sequence("_first", F.least(F.col("_first") + CHUNK - 1, F.col("_last")))).alias("slot"),
    )
