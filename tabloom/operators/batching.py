"""Micro-batches, training steps and padded batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import fixed, tokens
from tabloom.functions.text import whole, whole_up
from tabloom.functions.tokens import SpecialIds
from tabloom.operators.ordering import key_position, shuffled_position


def micro_batches(df: DataFrame, key: Sequence[str], size: int, out: str = "batch_id") -> DataFrame:
    """Slices of ``size`` consecutive rows in key order; the last one may be shorter."""
    numbered = key_position(df, key, out="_position")
    return numbered.withColumn(out, whole(F.col("_position"), size)).drop("_position")


def training_schedule(
    df: DataFrame, key: Sequence[str], batch_size: int = 2, accumulation: int = 4, epochs: int = 1,
    seed: int = fixed.SEED, max_steps: int | None = None,
) -> DataFrame:
    """Adds ``epoch, position, micro_batch, step``: where each row stands in each epoch's seeded order.

    The last partial batch and the last partial step of an epoch are kept. ``step`` counts on across
    epochs and ``max_steps`` cuts it. Pass only the columns the schedule has to carry.
    """
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = shuffled_position(repeated, key, seed=seed, epoch="epoch", total="_rows")
    micro = whole(F.col("position"), batch_size)
    steps_per_epoch = whole_up(F.col("_rows"), batch_size * accumulation)
    scheduled = (
        placed.withColumn("micro_batch", micro)
        .withColumn("step", F.col("epoch") * steps_per_epoch + whole(F.col("micro_batch"), accumulation))
        .drop("_rows")
    )
    return scheduled if max_steps is None else scheduled.filter(F.col("step") < max_steps)


def longest_in_batch(df: DataFrame, batch: Sequence[str], length: str = "length", out: str = "longest") -> DataFrame:
    """The largest length of the row's batch; a batch holds a fixed small number of rows."""
    return df.withColumn(out, F.max(length).over(Window.partitionBy(*batch)))


def padded_columns(ids: Column, length: Column | int, special: SpecialIds) -> list[Column]:
    """``input_ids, attention_mask`` at a common length."""
    return [
        tokens.padded(ids, length, special.padding).alias("input_ids"),
        tokens.mask(ids, length).alias("attention_mask"),
    ]


def lengths_of(encoded: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, length``, from the stored length where the table has one."""
    length = F.col("length") if "length" in encoded.columns else F.size("input_ids")
    return encoded.select(*key, length.alias("length"))


def pad_in_batches(
    encoded: DataFrame, key: Sequence[str], size: int, special: SpecialIds = SpecialIds(), multiple: int = 1
) -> DataFrame:
    """``key, batch_id, longest, input_ids, attention_mask`` padded to the longest of each micro-batch.

    Batches are found on keys and lengths alone; the id arrays move once, to meet their length.
    """
    lengths = lengths_of(encoded, key)
    sized = longest_in_batch(micro_batches(lengths, key, size), ["batch_id"])
    width = tokens.rounded_up(F.col("longest"), multiple) if multiple > 1 else F.col("longest")
    return (
        encoded.select(*key, "input_ids").join(sized.select(*key, "batch_id", width.alias("longest")), list(key))
        .select(*key, "batch_id", "longest", *padded_columns(F.col("input_ids"), F.col("longest"), special))
    )


def collate(
    encoded: DataFrame, key: Sequence[str], batch_size: int = 2, accumulation: int = 4, epochs: int = 1,
    seed: int = fixed.SEED, max_steps: int | None = None, multiple: int = fixed.PAD_MULTIPLE,
    special: SpecialIds = SpecialIds(),
) -> DataFrame:
    """Training batches: schedule, padding to a multiple of the longest row, mask and labels.

    ``encoded`` is read twice, once for its lengths, so it should be a stored table, best with a
    ``length`` column, which spares reading the ids for it.
    """
    lengths = lengths_of(encoded, key)
    schedule = training_schedule(lengths, key, batch_size, accumulation, epochs, seed, max_steps)
    sized = longest_in_batch(schedule, ["epoch", "micro_batch"])
    placed = sized.select(
        *key, "epoch", "position", "micro_batch", "step", tokens.rounded_up(F.col("longest"), multiple).alias("width")
    )
    batches = encoded.select(*key, "input_ids").join(placed, list(key)).select(
        *key, "epoch", "position", "micro_batch", "step", "width",
        *padded_columns(F.col("input_ids"), F.col("width"), special),
    )
    return batches.withColumn("labels", tokens.labels(F.col("input_ids"), special.padding))
