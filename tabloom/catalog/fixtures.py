"""The given tables seen as problems, instructions, chats, texts, judge responses and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.text import whole
from tabloom.operators.pairing import chunked_left_join
from tabloom.operators.vocabulary import build_vocabulary
from tabloom.session import materialize

# Rank file of a published vocabulary on this box; a parameter everywhere else.
SUBWORD_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Three ways in which published models mark turns.
TEMPLATES = {
    "chatml": (
        "{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n' }}{% endfor %}"
        "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
    ),
    "bracketed": """
{%- if messages[0]['role'] == 'system' %}
    {%- set rest = messages[1:] %}
    {%- set opening = '<<SYS>>\n' + messages[0]['content'] + '\n<</SYS>>\n\n' %}
{%- else %}
    {%- set rest = messages %}
    {%- set opening = '' %}
{%- endif %}
{%- for message in rest %}
    {%- if loop.first %}{% set content = opening + message['content'] %}{% else %}{% set content = message['content'] %}{% endif %}
    {%- if message['role'] == 'user' %}
        {{- bos_token + '[INST] ' + content|trim + ' [/INST]' }}
    {%- elif message['role'] == 'assistant' %}
        {{- ' ' + content|trim + ' ' + eos_token }}
    {%- endif %}
{%- endfor %}""",
    "effortful": """
{%- if reasoning_effort is not defined %}{% set reasoning_effort = 'medium' %}{% endif %}
{{- '<|start|>system<|message|>Reasoning: ' ~ reasoning_effort ~ '<|end|>' }}
{%- for message in messages %}
    {%- if message.role == 'system' %}{% set name = 'developer' %}{% else %}{% set name = message.role %}{% endif %}
    {{- '<|start|>' ~ name ~ '<|message|>' ~ message.content }}
    {%- if loop.last and message.role == 'assistant' and not add_generation_prompt %}{{ '<|return|>' }}{% else %}{{ '<|end|>' }}{% endif %}
{%- endfor %}
{%- if add_generation_prompt %}{{ '<|start|>assistant' }}{% endif %}""",
}
TURN_KEY = ("conv_id", "turn")
TEXT_KEY = ("example_id",)
# Turns of a conversation rendered or numbered in one task; segments of a longer one are put together again.
SEGMENT_TURNS = 64
# Turns of a conversation that meet its system text in one task.
CHUNK_TURNS = 1_024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, turn, Problem, Solution``: user turns with the assistant turn that follows."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("Problem"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Solution")
    )
    return asked.join(answered, list(TURN_KEY))


def instructions(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, turn, instruction, input, output``: the system text is the input where there is one."""
    system = table(spark, folder, "conversations").filter(F.col("role") == "system").select(
        "conv_id", F.col("text").alias("_system")
    )
    joined = chunked_left_join(pairs(spark, folder), system, "conv_id", whole(F.col("turn"), CHUNK_TURNS))
    return joined.select(
        *TURN_KEY, F.col("Problem").alias("instruction"), F.coalesce("_system", F.lit("")).alias("input"),
        F.col("Solution").alias("output"),
    )


def chats(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, segment, turn, role, text``."""
    segment = whole(F.col("turn"), SEGMENT_TURNS).alias("segment")
    return table(spark, folder, "conversations").select("conv_id", segment, "turn", "role", "text")


def held_out(spark: SparkSession, folder: str) -> DataFrame:
    """``example_id, Problem``."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("example_id"), F.col("text").alias("Problem"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """``example_id, text``."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("example_id"), "text")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """``example_id, evaluation_type, raw``: judge responses, some of them broken in various ways."""
    event, user = F.col("event_id"), F.col("user_id")
    whole = F.concat(
        F.lit('{"problem": "p'), event.cast("string"), F.lit('", "first_score": '), (1 + event % 10).cast("string"),
        F.lit(', "second_score": '), (1 + user % 10).cast("string"), F.lit("}"),
    )
    raw = (
        F.when(event % 13 == 0, "not json").when(event % 13 == 1, '{"first_score": 4}')
        .when(event % 13 == 2, F.lit(None)).when(event % 13 == 3, "[1]")
        .when(event % 13 == 4, F.replace(whole, F.lit('"'), F.lit("'"))).when(event % 13 == 5, F.concat(whole, F.lit(" done")))
        .when(event % 13 == 6, F.concat(whole, whole)).otherwise(whole)
    )
    kind = F.when(user % 2 == 0, "standard_inference").otherwise("vllm_inference")
    return table(spark, folder, "events").select(
        event.alias("example_id"), kind.alias("evaluation_type"), raw.alias("raw")
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """``example_id, engine, latency_us, started_at``."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("example_id"), F.col("event_type").alias("engine"),
        F.round(F.col("value") * 1000).cast("long").alias("latency_us"), F.col("ts").cast("timestamp").alias("started_at"),
    )


def run_steps(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, step, ok``: a run is a user, its steps are that user's events."""
    step = (
        F.when(F.col("event_id") % 4 == 0, "training").when(F.col("event_id") % 4 == 1, "inference")
        .when(F.col("event_id") % 4 == 2, "standard_evaluation").otherwise("vllm_evaluation")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), step.alias("step"), (F.col("event_id") % 97 != 0).alias("ok")
    )


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of the texts, built and stored."""
    return materialize(build_vocabulary(texts(spark, folder)), "vocabulary")
