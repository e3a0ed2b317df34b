"""Training and calibration data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.config import TrainingSettings
from tabloom.functions import chat, fixed, prompts, tokens
from tabloom.functions.tokens import SpecialIds
from tabloom.operators import subwords
from tabloom.operators.batching import collate, padded_columns
from tabloom.operators.selection import head
from tabloom.operators.subwords import Subwords
from tabloom.operators.vocabulary import encode
from tabloom.session import materialize
from tabloom.sources.problems import ingest_problems
from tabloom.sources.tables import load_split, scan_dataset

# A vocabulary built from the texts, or the subwords of a published model, which then bring their own special ids.
Vocabulary = DataFrame | Subwords


def _math(template: chat.ChatTemplate) -> Column:
    return chat.render(chat.training_turns(F.col("Problem"), F.col("Solution")), template)


def _instruction(template: chat.ChatTemplate) -> Column:
    return prompts.instruction_training_text(F.col("instruction"), F.col("input"), F.col("output"))


RENDERERS: dict[str, Callable[[chat.ChatTemplate], Column]] = {"math": _math, "alpaca": _instruction}


def _kind(kind: str) -> str:
    name = kind.lower()
    if name not in RENDERERS:
        raise ValueError(f"unsupported dataset type {kind!r}: use one of {', '.join(RENDERERS)}")
    return name


def training_source(
    spark: SparkSession, kind: str, source: str, work: str, key: Sequence[str] = ("example_id",), split: str = f"train[:{fixed.HEAD_ROWS}]"
) -> DataFrame:
    """Source rows by dataset type: a problem CSV ingested below ``work``, or a split of an instruction dataset."""
    if _kind(kind) == "math":
        return ingest_problems(spark, source, work)[0]
    return load_split(scan_dataset(spark, source), key, split)


def training_texts(df: DataFrame, kind: str, template: chat.ChatTemplate = chat.CHATML) -> DataFrame:
    """Adds ``text``, rendered the way the dataset type asks for."""
    return df.withColumn("text", RENDERERS[_kind(kind)](template))


def _special(vocabulary: Vocabulary, special: SpecialIds) -> SpecialIds:
    return vocabulary.special if isinstance(vocabulary, Subwords) else special


def _encoded(
    texts: DataFrame, vocabulary: Vocabulary, key: Sequence[str], max_length: int, special: SpecialIds, keep_text: bool,
    add_special: bool = False,
) -> DataFrame:
    """``key, input_ids, length``, and the text if it is kept; subwords need neither a shuffle nor a join for it."""
    if isinstance(vocabulary, Subwords):
        kept = [*key, "text"] if keep_text else key
        return subwords.encode(texts, vocabulary, kept, max_length=max_length, add_special=add_special)
    rows = encode(texts, vocabulary, key, max_length=max_length, add_special=add_special, special=special)
    return rows.join(texts.select(*key, "text"), list(key)) if keep_text else rows


def tokenized(
    texts: DataFrame, vocabulary: Vocabulary, kind: str, key: Sequence[str], max_length: int = fixed.MAX_LENGTH,
    special: SpecialIds = SpecialIds(),
) -> DataFrame:
    """``input_ids, attention_mask`` of fixed length; math rows keep their text, instruction rows do not."""
    keep = _kind(kind) == "math"
    rows = _encoded(texts, vocabulary, key, max_length, special, keep)
    padded = padded_columns(F.col("input_ids"), max_length, _special(vocabulary, special))
    return rows.select(*key, *padded, *(["text"] if keep else []))


def prepare(
    df: DataFrame, vocabulary: Vocabulary, kind: str, key: Sequence[str], max_length: int = fixed.MAX_LENGTH,
    special: SpecialIds = SpecialIds(), template: chat.ChatTemplate = chat.CHATML,
) -> DataFrame:
    """From source rows to fixed-length token rows."""
    return tokenized(training_texts(df, kind, template), vocabulary, kind, key, max_length, special)


def calibration_sample(
    instructions: DataFrame, vocabulary: Vocabulary, key: Sequence[str], rows: int = fixed.CALIBRATION_ROWS,
    max_length: int = fixed.MAX_LENGTH, special: SpecialIds = SpecialIds(),
) -> DataFrame:
    """Unpadded token rows, special ids included, of the first instruction examples, with their text."""
    chosen = training_texts(head(instructions, rows, key), "alpaca").select(*key, "text")
    rows = _encoded(chosen, vocabulary, key, max_length, special, keep_text=True, add_special=True)
    return rows.select(*key, "input_ids", tokens.mask(F.col("input_ids"), F.size("input_ids")).alias("attention_mask"), "text")


def training_batches(
    texts: DataFrame, vocabulary: Vocabulary, key: Sequence[str], settings: TrainingSettings = TrainingSettings(),
    multiple: int = fixed.PAD_MULTIPLE, special: SpecialIds = SpecialIds(),
) -> DataFrame:
    """Collated batches for an external trainer. The encoded rows are stored once in between."""
    encoded = materialize(_encoded(texts, vocabulary, key, settings.max_length, special, keep_text=False), "encoded")
    return collate(
        encoded, key, settings.batch_size, settings.gradient_accumulation_steps, settings.num_epochs, settings.seed,
        settings.max_steps, multiple, _special(vocabulary, special),
    )
