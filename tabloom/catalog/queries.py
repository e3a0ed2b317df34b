"""One DataFrame per registered query."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.catalog import fixtures
from tabloom.catalog.fixtures import TEXT_KEY, TURN_KEY
from tabloom.config import EvaluationSettings, TrainingSettings, resolved, unknown_keys
from tabloom.functions import chat, fixed, prompts, tokens
from tabloom.functions import text as texts
from tabloom.functions.templates import compile_template
from tabloom.functions.tokens import SpecialIds
from tabloom.operators import batching, calls, mapping, pairing, selection, subwords, summaries, vocabulary
from tabloom.operators.plugins import (
    ConstantJudge, EchoingWords, FailingAtFirst, LeadingWords, NeverAnswers, Streamed, TimedWords, WordCountJudge,
)
from tabloom.operators.subwords import Subwords
from tabloom.plans import evaluation, experiment, training
from tabloom.session import materialize, work_path
from tabloom.sources import experiment_log, problems, results, tables
from tabloom.streaming import scoreboard

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TUNED = partial(LeadingWords, 32)
BASE = partial(LeadingWords, 16)
STOPS = ("\n", ". ")
SPECIAL = SpecialIds()
ENGINES = ("standard_inference", "vllm_inference")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def joined(ids: str | Column) -> Column:
    """Ids as comparable text."""
    return F.array_join((F.col(ids) if isinstance(ids, str) else ids).cast("array<string>"), " ")


# Rendering


@query
def render_instruction_training(spark, folder):
    return training.training_texts(fixtures.instructions(spark, folder), "alpaca").select(*TURN_KEY, "text")


@query
def render_chat_training(spark, folder):
    return training.training_texts(fixtures.pairs(spark, folder), "math").select(*TURN_KEY, "text")


@query
def render_conversation(spark, folder):
    turn = F.struct("turn", F.struct(F.col("role"), F.col("text").alias("content")).alias("message"))
    listed = fixtures.chats(spark, folder).groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    messages = F.transform("turns", lambda t: t["message"])
    parts = listed.select("conv_id", F.struct("segment", chat.render_messages(messages).alias("text")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


@query
def render_compiled(spark, folder):
    """Every conversation under three compiled templates, as training text and as a prompt."""
    turn = F.struct("turn", F.struct(F.col("role"), F.col("text").alias("content")).alias("message"))
    listed = fixtures.chats(spark, folder).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: t["message"])
    marks = {"bos_token": "<s>", "eos_token": "</s>"}
    rendered = {
        "chatml": compile_template(fixtures.TEMPLATES["chatml"], messages),
        "chatml_prompt": compile_template(fixtures.TEMPLATES["chatml"], messages, generation=True),
        "bracketed": compile_template(fixtures.TEMPLATES["bracketed"], messages, **marks),
        "effortful_prompt": compile_template(fixtures.TEMPLATES["effortful"], messages, generation=True, reasoning_effort="high"),
    }
    return listed.select("conv_id", *[text.alias(name) for name, text in rendered.items()])


@query
def render_math_prompt(spark, folder):
    return evaluation.chat_prompts(fixtures.held_out(spark, folder)).select(*TEXT_KEY, "prompt")


@query
def render_math_prompt_plain(spark, folder):
    return evaluation.plain_prompts(fixtures.held_out(spark, folder)).select(*TEXT_KEY, "prompt")


@query
def render_instruction_prompt(spark, folder):
    rows = fixtures.instructions(spark, folder)
    return rows.select(*TURN_KEY, prompts.instruction_prompt(F.col("instruction"), F.col("input")).alias("prompt"))


@query
def render_instruction_chat(spark, folder):
    rows = fixtures.instructions(spark, folder)
    turns = chat.instruction_turns(F.col("instruction"), F.col("input"), F.col("output"))
    return rows.select(*TURN_KEY, chat.render(turns).alias("text"))


@query
def render_judge_prompt(spark, folder):
    rows = fixtures.pairs(spark, folder)
    first, second = leading_words("Problem", 32), leading_words("Problem", 16)
    return rows.select(*TURN_KEY, prompts.judge_prompt(F.col("Problem"), first, second).alias("prompt"))


def leading_words(column: str, words: int) -> Column:
    """The rule of the trial generator as an expression."""
    return F.array_join(F.slice(F.regexp_extract_all(F.col(column), F.lit("[^ \n]+"), F.lit(0)), 1, words), " ")


@query
def typed_training_text(spark, folder):
    parts = [
        training.training_texts(rows(spark, folder), kind).select(F.lit(kind.lower()).alias("kind"), *TURN_KEY, "text")
        for kind, rows in (("MATH", fixtures.pairs), ("Alpaca", fixtures.instructions))
    ]
    return experiment.bag_union(parts)


def characters(columns):
    """A user function: lists of column values in, a list per new column out."""
    return {"characters": [sum(map(len, row)) for row in zip(*columns.values())]}


@query
def batched_map(spark, folder):
    rows, sources = fixtures.instructions(spark, folder), ["instruction", "input", "output"]
    added = T.StructType([T.StructField("characters", T.LongType())])
    return mapping.map_batches(rows, characters, added, sources, remove=["input", "output"])


# Selection


@query
def head_split(spark, folder):
    return tables.load_split(fixtures.pairs(spark, folder), TURN_KEY, "train[:100]")


@query
def instruction_scan_split(spark, folder):
    path = work_path(spark, "instructions")
    split = F.when(F.col("conv_id") % 10 == 9, "test").otherwise("train")
    fixtures.instructions(spark, folder).withColumn("split", split).write.partitionBy("split").parquet(path)
    chosen = tables.load_split(tables.scan_dataset(spark, path), TURN_KEY, "train[:1000]")
    return chosen.select(*TURN_KEY, F.col("instruction").alias("asked"), "output")


@query
def too_long_prompts(spark, folder):
    _, long = selection.split_too_long(fixtures.texts(spark, folder), "text", 512)
    return long.select(*TEXT_KEY, F.col("tokens").cast("long").alias("tokens"))


@query
def dataset_shape(spark, folder):
    return summaries.shape(fixtures.table(spark, folder, "documents"))


# Text


@query
def stop_cut(spark, folder):
    return fixtures.texts(spark, folder).select(*TEXT_KEY, texts.cut_at_stop(F.col("text"), STOPS).alias("text"))


@query
def strip_echo(spark, folder):
    asked = evaluation.chat_prompts(fixtures.pairs(spark, folder))
    decoded = F.when(F.col("turn") % 4 < 2, F.concat("prompt", "Solution")).otherwise(F.col("Solution"))
    return asked.select(*TURN_KEY, texts.without_echo(decoded, F.col("prompt")).alias("completion"))


@query
def zip_columns(spark, folder):
    turns = fixtures.chats(spark, folder)
    roles = pairing.numbered(turns.select("conv_id", "segment", "turn", "role"), "conv_id", "segment", "turn")
    texts_ = pairing.numbered(turns.filter(F.col("turn") % 7 != 6).select("conv_id", "segment", "turn", "text"), "conv_id", "segment", "turn")
    # Rows beyond the end of the shorter list meet nothing.
    return roles.select("conv_id", "position", "role").join(texts_.select("conv_id", "position", "text"), ["conv_id", "position"])


@query
def result_access(spark, folder):
    output = F.array(F.struct(F.array(F.struct("text")).alias("outputs")))
    rows = fixtures.chats(spark, folder).select("conv_id", "turn", output.alias("response"))
    path = work_path(spark, "responses")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path).select("conv_id", "turn", F.col("response")[0]["outputs"][0]["text"].alias("text"))


@query
def json_encode(spark, folder):
    return fixtures.chats(spark, folder).select("conv_id", "turn", texts.json_text("role", "text").alias("json"))


@query
def timestamps(spark, folder):
    rows = fixtures.timings(spark, folder)
    bounded = texts.at_most(F.col("latency_us"), 20_000)
    return rows.select(*TEXT_KEY, texts.timestamp_text(F.col("started_at")).alias("started_at"), bounded.alias("latency_us"))


@query
def elapsed(spark, folder):
    slow = F.when(F.col("latency_us") > 10_000, F.col("latency_us"))
    return fixtures.timings(spark, folder).groupBy("engine").agg(
        texts.elapsed_us(F.min("started_at"), F.max("started_at")).alias("elapsed_us"),
        texts.mean_or_zero(slow).alias("mean_slow_us"),
    )


# Tokens


@query
def vocab(spark, folder):
    return vocabulary.build_vocabulary(fixtures.texts(spark, folder)).withColumn("id", F.col("id").cast("long"))


@query
def vocab_whole(spark, folder):
    return vocab(spark, folder)


@query
def vocab_frequent(spark, folder):
    rows = vocabulary.build_vocabulary(fixtures.texts(spark, folder), size=1_000)
    return rows.withColumn("id", F.col("id").cast("long"))


def encoded_texts(spark, folder, **options) -> DataFrame:
    return vocabulary.encode(fixtures.texts(spark, folder), fixtures.vocabulary(spark, folder), TEXT_KEY, **options)


@query
def encode(spark, folder):
    return encoded_texts(spark, folder).select(*TEXT_KEY, joined("input_ids").alias("input_ids"))


@query
def encode_whole(spark, folder):
    rows = encoded_texts(spark, folder)
    return rows.select(*TEXT_KEY, F.col("length").cast("long").alias("length"), joined("input_ids").alias("input_ids"))


@query
def decode(spark, folder):
    known = fixtures.vocabulary(spark, folder)
    return vocabulary.decode(vocabulary.encode(fixtures.texts(spark, folder), known, TEXT_KEY), known, TEXT_KEY)


@query
def decoded_clean(spark, folder):
    known = fixtures.vocabulary(spark, folder)
    framed = vocabulary.encode(fixtures.texts(spark, folder), known, TEXT_KEY, add_special=True)
    return vocabulary.decode(framed, known, TEXT_KEY)


@query
def decode_exact(spark, folder):
    """Tokens that hold the blanks before them give back every text as it was."""
    rows = fixtures.texts(spark, folder)
    known = materialize(vocabulary.build_vocabulary(rows, spaced=True), "vocabulary")
    return vocabulary.decode(vocabulary.encode(rows, known, TEXT_KEY, spaced=True), known, TEXT_KEY, spaced=True)


# Subwords of a published model; the first free id ends a text.
SUBWORDS = Subwords(fixtures.SUBWORD_FILE, SpecialIds(unknown=50256, begin=50256, end=50256))


@query
def subword_encode(spark, folder):
    rows = subwords.encode(fixtures.texts(spark, folder), SUBWORDS, TEXT_KEY)
    return rows.select(*TEXT_KEY, F.col("length").cast("long").alias("length"), joined("input_ids").alias("input_ids"))


@query
def subword_decode(spark, folder):
    """Ids of a published vocabulary give back every text as it was."""
    return subwords.decode(subwords.encode(fixtures.texts(spark, folder), SUBWORDS, TEXT_KEY), SUBWORDS, TEXT_KEY)


@query
def subword_vocab(spark, folder):
    rows = subwords.count_subwords(fixtures.texts(spark, folder), SUBWORDS)
    return rows.select(F.col("id").cast("long").alias("id"), F.hex("token").alias("token"), "n")


@query
def subword_training_rows(spark, folder):
    """From source rows to fixed-length rows under a published vocabulary."""
    ready = training.prepare(fixtures.pairs(spark, folder), SUBWORDS, "math", TURN_KEY)
    return ready.select(
        *TURN_KEY, "text", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask")
    )


@query
def subword_batches(spark, folder):
    """Collated training batches under a published vocabulary, as figures per batch."""
    rows = training.training_texts(fixtures.instructions(spark, folder), "alpaca")
    batches = training.training_batches(rows, SUBWORDS, TURN_KEY, TrainingSettings(max_steps=None))
    return batches.groupBy("epoch", "micro_batch").agg(
        F.count("*").alias("row_count"), F.max("width").cast("long").alias("width"),
        F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)).alias("kept"),
        F.sum(F.aggregate("labels", F.lit(0).cast("long"), lambda a, i: a + F.when(i >= 0, i).otherwise(0))).alias("label_sum"),
    ).select(F.col("epoch").cast("long").alias("epoch"), F.col("micro_batch").cast("long").alias("micro_batch"), "row_count", "width", "kept", "label_sum")


@query
def generated_capped(spark, folder):
    """The first new tokens of an answer, the cap that generation sets."""
    rows = encoded_texts(spark, folder).select(*TEXT_KEY, calls.cap_tokens("input_ids").alias("input_ids"))
    return rows.select(*TEXT_KEY, joined("input_ids").alias("input_ids"))


MARKED = SpecialIds(markers=(("<|endoftext|>", 3), ("<|im_start|>", 4), ("<|im_end|>", 5)))


@query
def encode_marked(spark, folder):
    """Rendered training texts with one id per marker; instruction texts end in the end-of-text id."""
    rows = typed_training_text(spark, folder)
    key = ("kind", *TURN_KEY)
    known = materialize(vocabulary.build_vocabulary(rows, special=MARKED), "vocabulary")
    ids = vocabulary.encode(rows, known, key, special=MARKED)
    back = vocabulary.decode(ids, known, key, special=MARKED)
    return ids.select(*key, joined("input_ids").alias("input_ids"), F.element_at("input_ids", -1).cast("long").alias("last")).join(back, list(key))


@query
def truncate_pad_mask(spark, folder):
    rows = encoded_texts(spark, folder, max_length=fixed.MAX_LENGTH)
    padded = rows.select(*TEXT_KEY, *batching.padded_columns(F.col("input_ids"), fixed.MAX_LENGTH, SPECIAL))
    return padded.select(*TEXT_KEY, joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


@query
def labels_masked(spark, folder):
    rows = encoded_texts(spark, folder, add_special=True)
    width = F.greatest(F.size("input_ids"), F.lit(fixed.MAX_LENGTH))
    padded = tokens.padded(F.col("input_ids"), width, SPECIAL.padding)
    return rows.select(*TEXT_KEY, joined(tokens.labels(padded, SPECIAL.padding)).alias("labels"))


@query
def calibration_sample(spark, folder):
    rows = fixtures.instructions(spark, folder)
    known = materialize(vocabulary.build_vocabulary(training.training_texts(rows, "alpaca")), "vocabulary")
    sample = training.calibration_sample(rows, known, TURN_KEY)
    return sample.select(
        *TURN_KEY, "text", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask")
    )


@query
def prepared_training_rows(spark, folder):
    rows = fixtures.pairs(spark, folder)
    known = materialize(vocabulary.build_vocabulary(training.training_texts(rows, "math")), "vocabulary")
    ready = training.prepare(rows, known, "math", TURN_KEY)
    return ready.select(
        *TURN_KEY, "text", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask")
    )


@query
def prepared_instruction_rows(spark, folder):
    rows = fixtures.instructions(spark, folder)
    known = materialize(vocabulary.build_vocabulary(training.training_texts(rows, "alpaca")), "vocabulary")
    ready = training.prepare(rows, known, "Alpaca", TURN_KEY)
    return ready.select(*TURN_KEY, joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


@query
def pad_longest_in_batch(spark, folder):
    stored = materialize(encoded_texts(spark, folder), "encoded")
    rows = batching.pad_in_batches(stored, TEXT_KEY, 8, SPECIAL)
    return rows.select(*TEXT_KEY, "batch_id", F.col("longest").cast("long").alias("longest"),
                       joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


@query
def training_batches(spark, folder):
    return scheduled(spark, folder)


@query
def training_steps_capped(spark, folder):
    """The same schedule cut after so many optimizer steps."""
    return scheduled(spark, folder, fixed.MAX_STEPS)


def scheduled(spark, folder, max_steps=None) -> DataFrame:
    lengths = fixtures.texts(spark, folder).select(*TEXT_KEY, F.size(tokens.split_tokens(F.col("text"))).alias("length"))
    schedule = batching.training_schedule(lengths, TEXT_KEY, epochs=2, max_steps=max_steps)
    rows = batching.longest_in_batch(schedule, ["epoch", "micro_batch"])
    wide = tokens.rounded_up(F.col("longest")).cast("long")
    return rows.select(*TEXT_KEY, F.col("epoch").cast("long").alias("epoch"), "position", "micro_batch", "step", wide.alias("width"))


@query
def collated_batches(spark, folder):
    known = fixtures.vocabulary(spark, folder)
    rows = training.training_batches(fixtures.texts(spark, folder), known, TEXT_KEY, TrainingSettings(max_length=None))
    return rows.select(
        *TEXT_KEY, "micro_batch", "step", joined("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).cast("long").alias("attended"),
        joined("labels").alias("labels"),
    )


# Generation and judging


def tuned_results(spark, folder) -> DataFrame:
    return evaluation.generate_results(fixtures.pairs(spark, folder), TUNED, TURN_KEY, "standard_inference")


RECORD = (*TURN_KEY, "problem", "original_solution", "generated_solution")


@query
def generate_stub(spark, folder):
    return tuned_results(spark, folder).select(*RECORD, "engine", "error")


@query
def generation_roundtrip(spark, folder):
    rows = fixtures.pairs(spark, folder).select(
        *TURN_KEY, "Problem", "Solution", leading_words("Problem", 32).alias("generated_solution"), F.lit("tuned").alias("engine")
    )
    path = work_path(spark, "results")
    results.write_results(rows.select(*results.result_columns(rows), "engine"), path, "json")
    return results.read_results(spark, path, multi_line=False)


@query
def csv_problems(spark, folder):
    blanked = F.when(F.col("conv_id") % 5 == 0, "NA").otherwise(F.col("Solution")).alias("Solution")
    path = work_path(spark, "problems-csv")
    problems.write_problems(fixtures.pairs(spark, folder).select("Problem", blanked), path)
    whole, incomplete = problems.ingest_problems(spark, path, work_path(spark, "problems"))
    flagged = [d.select("Problem", "Solution", F.lit(n).alias("complete")) for d, n in ((whole, 1), (incomplete, 0))]
    return experiment.bag_union(flagged).withColumn("complete", F.col("complete").cast("long"))


@query
def csv_problems_split(spark, folder):
    """Texts with line breaks and doubled quotes in one CSV file, read in as many tasks as it has splits."""
    quoted = F.concat(F.lit('"Quoted", she said,\n\n"'), "Problem", F.lit('"\n')).alias("Problem")
    path, columns = work_path(spark, "problems-csv"), (*TURN_KEY, *problems.COLUMNS)
    problems.write_problems(fixtures.pairs(spark, folder).select(*TURN_KEY, quoted, "Solution").repartition(1), path, columns)
    return problems.read_problems_split(spark, path, columns).select(
        *[F.col(c).cast("long").alias(c) for c in TURN_KEY], *problems.COLUMNS
    )


@query
def json_array_split(spark, folder):
    """All texts in JSON array files, one per 256 MB, each read in as many tasks as it has splits."""
    rows, path = fixtures.texts(spark, folder), work_path(spark, "array")
    results.write_json_array(results.in_files(rows, ["text"]), path)
    return results.read_json_array(spark, path, rows.schema).select(*TEXT_KEY, "text")


@query
def experiment_log_split(spark, folder):
    """Log documents that list all experiments of a folder, read in as many tasks as they have splits."""
    path = work_path(spark, "log")
    entries = experiment_log.entries(fixtures.responses(spark, folder), TEXT_KEY, LOG_TIME, "results", "run")
    results.write_json_array(entries, path, '{"experiments": [', "]}")
    read = experiment_log.read_log_arrays(spark, path)
    scored = read.select("metadata", F.explode("comparisons").alias("raw"))
    return scored.groupBy(F.col("metadata.evaluation_type").alias("evaluation_type")).agg(
        F.count("*").alias("responses"), F.max("metadata.total_comparisons").alias("total_comparisons"),
        F.count("raw").alias("answered"), F.sum(F.length("raw")).alias("characters"), F.max("raw").alias("last"),
    )


@query
def pair_outputs(spark, folder):
    rows = fixtures.pairs(spark, folder)
    tuned = evaluation.generate_results(rows, TUNED, TURN_KEY, "standard_inference").select(*TURN_KEY, "problem", "generated_solution")
    base = evaluation.generate_results(rows, BASE, TURN_KEY, "base").select(*TURN_KEY, F.col("generated_solution").alias("solution"))
    return pairing.pair_outputs(tuned, base, TURN_KEY)


@query
def calls_resumed(spark, folder):
    """Prompts that fail at first are called again, in rounds; a third of them would need one attempt more."""
    rows, place = evaluation.plain_prompts(fixtures.pairs(spark, folder)).select(*TURN_KEY, "prompt"), work_path(spark, "calls")

    def step_of(attempt: int):
        return lambda part: calls.generate(part, partial(FailingAtFirst, 16, attempt), TURN_KEY, workers=4, batch_rows=8)

    calls.with_attempts(rows, TURN_KEY, 3, step_of, place, attempts=1)
    answered = calls.with_attempts(rows, TURN_KEY, 3, step_of, place, attempts=2)
    return answered.select(*TURN_KEY, "generated_solution", "error")


@query
def judge_paced(spark, folder):
    """Calls of four judges under one rate: how many there are, and in how many tenths of a second the rate was exceeded."""
    rate, callers = 2_000, 4
    rows = evaluation.plain_prompts(fixtures.held_out(spark, folder)).select(*TEXT_KEY, "prompt")
    sent = materialize(calls.judge(rows, ConstantJudge, TEXT_KEY, workers=callers, calls_per_second=rate, sent=True), "sent")
    tenths = sent.groupBy((F.col("sent_us") / 100_000).cast("long").alias("tenth")).agg(F.count("*").alias("calls"))
    return tenths.agg(
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count_if(F.col("calls") > rate // 10 + callers).alias("exceeded")
    )


@query
def first_token_latency(spark, folder):
    """Times to the first part of an answer and between parts, of a trial model on a clock of its own."""
    rows = evaluation.plain_prompts(fixtures.pairs(spark, folder)).withColumn("short", F.length("Problem") % 2 == 0)
    parts = [
        calls.generate(rows.filter(F.col("short") == (words == 8)).drop("short"), partial(Streamed, partial(TimedWords, words)), TURN_KEY, engine=name, timed=True)
        for name, words in (("brief", 8), ("long", 32))
    ]
    measured = experiment.bag_union([p.select(*TURN_KEY, "engine", "latency_us", "first_token_us", "last_token_us", "parts") for p in parts])
    return summaries.latency_summary(measured).select("engine", "samples", "mean_first_token_us", "mean_between_us")


def stub_evaluation(spark, folder, **options) -> evaluation.Evaluation:
    judge = options.pop("judge", WordCountJudge)
    return evaluation.evaluate(
        tuned_results(spark, folder), BASE, judge, TURN_KEY, EvaluationSettings(io_workers=8), stored=False
    )


@query
def judge_stub(spark, folder):
    rows = summaries.with_scores(stub_evaluation(spark, folder).comparisons)
    return rows.select(*TURN_KEY, "first_score", "second_score", "error")


@query
def judge_disabled(spark, folder):
    disabled = stub_evaluation(spark, folder, judge=None)
    columns = (*TURN_KEY, "base_solution")
    parts = [
        frame.select(F.lit(kind).alias("kind"), *columns)
        for kind, frame in (("base_output", disabled.base_outputs), ("comparison", disabled.comparisons))
    ]
    return experiment.bag_union(parts)


@query
def evaluate_engine(spark, folder):
    return stub_evaluation(spark, folder).summary()


@query
def engines_side_by_side(spark, folder):
    scored = summaries.with_scores(fixtures.responses(spark, folder)).withColumn("batch_id", texts.whole(F.col("example_id"), 20))
    means = scored.groupBy("batch_id", "evaluation_type").agg(
        F.sum("first_score").alias("first"), F.sum("second_score").alias("second")
    )
    return pairing.side_by_side(means, ["batch_id"], "evaluation_type", ENGINES, ["first", "second"])


# Scores


@query
def score_parse(spark, folder):
    rows = summaries.with_scores(fixtures.responses(spark, folder)).filter("valid")
    return rows.select(*TEXT_KEY, "evaluation_type", "first_score", "second_score")


@query
def score_rejects(spark, folder):
    _, rejects = selection.split_by(summaries.with_scores(fixtures.responses(spark, folder)), F.col("valid"))
    return rejects.select(*TEXT_KEY, "evaluation_type", "raw")


@query
def score_summary(spark, folder):
    return summaries.score_summary(summaries.with_scores(fixtures.responses(spark, folder)))


@query
def score_strict(spark, folder):
    rows = fixtures.responses(spark, folder)
    trailing = F.when(F.col("example_id") % 5 == 0, F.concat("raw", F.lit(" done"))).otherwise(F.col("raw"))
    return summaries.score_summary(summaries.with_scores(rows.withColumn("raw", trailing), strict=True), ["evaluation_type"])


@query
def score_by_engine(spark, folder):
    return summaries.score_summary(summaries.with_scores(fixtures.responses(spark, folder)), ["evaluation_type"])


@query
def score_stream(spark, folder):
    source, out = work_path(spark, "responses"), work_path(spark, "board")
    fixtures.responses(spark, folder).select("evaluation_type", "raw").write.json(source)
    stream = scoreboard.comparison_stream(spark, source)
    scoreboard.start_scoreboard(stream, out, work_path(spark, "progress"), available_now=True).awaitTermination()
    return scoreboard.latest_board(spark, out)


@query
def score_stream_replaced(spark, folder):
    """Every response is delivered; then every third is asked again and replaced, and every second delivered once more."""
    source, out, progress = work_path(spark, "responses"), work_path(spark, "board"), work_path(spark, "progress")
    rows = materialize(fixtures.responses(spark, folder), "responses")
    other = rows.select((F.col("example_id") - 1).alias("example_id"), F.col("raw").alias("_other"))
    again = rows.filter(F.col("example_id") % 3 == 0).join(other, "example_id").select(
        "example_id", "evaluation_type", F.col("_other").alias("raw"), F.lit(1).alias("attempt")
    )
    first = rows.withColumn("attempt", F.lit(0))
    schema = rows.withColumns({"attempt": F.lit(0).cast("long"), "experiment_id": F.lit("")}).schema
    for delivery in (first, again, first.filter(F.col("example_id") % 2 == 0)):
        delivery.withColumn("experiment_id", F.concat(F.lit("run-"), "evaluation_type")).write.mode("append").json(source)
        stream = scoreboard.response_stream(spark, source, schema)
        scoreboard.start_replacing_scoreboard(stream, TEXT_KEY, out, progress, available_now=True).awaitTermination()
    board = scoreboard.latest_board(spark, out)
    return board.select("experiment_id", "evaluation_type", "finetuned_avg", "base_avg", F.col("valid").alias("total_comparisons"), F.col("responses").alias("all_comparisons"))


@query
def run_status(spark, folder):
    return summaries.run_status(fixtures.run_steps(spark, folder))


@query
def latency_by_engine(spark, folder):
    rows = summaries.latency_summary(fixtures.timings(spark, folder))
    return rows.withColumn("total_seconds", texts.scaled(F.col("total_us"), 1_000_000, 3))


# Runs and settings


@query
def config_resolved(spark, folder):
    events = fixtures.table(spark, folder, "events")
    k = F.from_json("props", "map<string,string>")
    override = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("max_new_tokens"), k["k"])).otherwise(k)
    config = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("temperature"), F.lit("0.0"), F.lit("max_new_tokens"), F.lit("64"))
                    ).otherwise(F.create_map(F.lit("temperature"), F.lit("1.0")))
    defaults = {"max_new_tokens": "128", "temperature": "0.5", "do_sample": "False"}
    rows = events.select(F.col("event_id").alias("example_id"), override.alias("override"), config.alias("config"))
    settled = rows.select(
        *TEXT_KEY, resolved(F.col("override"), F.col("config"), defaults).alias("_s"),
        F.array_join(unknown_keys(F.col("override"), defaults), ",").alias("unknown"),
    )
    return settled.select(*TEXT_KEY, "unknown", *[F.col("_s")[n].alias(n) for n in defaults])


LOG_TIME = "2024-01-01 00:00:00"


@query
def experiment_log_history(spark, folder):
    rows = materialize(fixtures.responses(spark, folder), "responses")
    log, documents = work_path(spark, "log"), work_path(spark, "documents")
    for kind in ENGINES:
        own = rows.filter(F.col("evaluation_type") == kind).drop("evaluation_type")
        experiment_log.append_experiment(own, log, f"first-{kind}", kind, "results", LOG_TIME)
    entries = experiment_log.entries(rows, TEXT_KEY, LOG_TIME, "results", "second")
    old = F.col("metadata.evaluation_type") == ENGINES[0]
    bare, listed = entries.filter(old), entries.filter(~old).select(F.array(F.struct(*entries.columns)).alias("experiments"))
    experiment.bag_union([bare, listed]).write.json(documents)
    key = rows.select(*TEXT_KEY).schema
    appended = experiment_log.read_comparisons(spark, log, key).groupBy("experiment_id", "evaluation_type").agg(
        F.count("*").alias("responses")
    ).join(experiment_log.read_experiments(spark, log).select("experiment_id", "total_comparisons"), "experiment_id")
    upgraded, _ = experiment_log.read_log_documents(spark, documents, multi_line=False)
    read = experiment_log.assembled(upgraded)
    return experiment.bag_union([appended, read]).groupBy("evaluation_type").agg(
        F.count("*").alias("entries"), F.count_distinct("experiment_id").alias("experiments"),
        F.sum("responses").alias("responses"), F.sum("total_comparisons").alias("total_comparisons"),
    )


@query
def log_concurrent(spark, folder):
    """Two writers at once, one of which then repeats its append with fewer responses."""
    rows, log = materialize(fixtures.responses(spark, folder), "responses"), work_path(spark, "log")

    def append(kind: str, chosen: DataFrame) -> None:
        own = chosen.filter(F.col("evaluation_type") == kind).drop("evaluation_type")
        experiment_log.append_experiment(own, log, f"e-{kind}", kind, "results", LOG_TIME)

    with ThreadPoolExecutor(2) as writers:
        list(writers.map(lambda kind: append(kind, rows), ENGINES))
    append(ENGINES[0], rows.filter(F.col("example_id") % 3 == 0))
    kept = experiment_log.read_comparisons(spark, log, rows.select(*TEXT_KEY).schema)
    counted = kept.groupBy("experiment_id").agg(F.count("*").alias("responses"), F.sum("example_id").alias("id_sum"), F.max("raw").alias("last"))
    return counted.join(experiment_log.read_experiments(spark, log).select("experiment_id", "evaluation_type", "total_comparisons"), "experiment_id")


def flat_record(record: DataFrame) -> DataFrame:
    scores = ("finetuned_avg_score", "base_avg_score", "total_comparisons")
    return record.select(
        "run_id", "status", F.col("lora_config.r").cast("long").alias("lora_r"),
        F.array_join("lora_config.target_modules", ",").alias("target_modules"),
        F.col("training_config.optimizer").alias("optimizer"), F.col("training_results.training_time").alias("training_time"),
        *[F.col(f"{e}_results")[s].alias(f"{e}_{s}") for e in ENGINES for s in scores],
    )


def stub_experiment() -> experiment.Experiment:
    return experiment.Experiment(
        run_id="run-1", timestamp=LOG_TIME, key=TURN_KEY,
        engines=(experiment.Engine(ENGINES[0], TUNED), experiment.Engine(ENGINES[1], partial(LeadingWords, 6), plain=True)),
        make_base=BASE, make_judge=WordCountJudge, settings=EvaluationSettings(io_workers=8),
    )


@query
def run_record(spark, folder):
    scored = summaries.with_scores(fixtures.responses(spark, folder)).withColumnRenamed("evaluation_type", "engine")
    return flat_record(experiment.run_record(summaries.score_summary(scored, ["engine"]), stub_experiment()))


@query
def experiment_run(spark, folder):
    record = experiment.run_experiment(
        fixtures.pairs(spark, folder), stub_experiment(), work_path(spark, "results"), work_path(spark, "log")
    )
    return flat_record(record)


@query
def experiment_failures(spark, folder):
    """Status and error count of a run whose judge always fails, one whose second engine does, and a sound one."""
    sound, rows = stub_experiment(), fixtures.pairs(spark, folder)
    second = replace(sound.engines[1], make=NeverAnswers)
    runs = {"judge": replace(sound, make_judge=NeverAnswers), "engine": replace(sound, engines=(sound.engines[0], second)), "none": sound}
    parts = [
        experiment.run_experiment(rows, run).select(F.lit(name).alias("failing"), "status", "errors") for name, run in runs.items()
    ]
    return experiment.bag_union(parts)


@query
def engine_options(spark, folder):
    """An engine that echoes its prompt, takes no long prompts and answers briefly."""
    rows = evaluation.generate_results(
        fixtures.pairs(spark, folder), partial(EchoingWords, 32), TURN_KEY, "echoing", plain=True, strip_echo=True,
        max_new_tokens=8, max_model_len=64,
    )
    return rows.select(*TURN_KEY, "generated_solution", "error")


@query
def evaluate_from_file(spark, folder):
    """Results written as JSON lines with their keys, read again and judged."""
    path, key = work_path(spark, "results"), fixtures.pairs(spark, folder).select(*TURN_KEY).schema
    results.write_results(tuned_results(spark, folder).select(*RECORD, "engine"), path, "json")
    return evaluation.evaluate_file(
        spark, path, "standard_inference", key, BASE, WordCountJudge, EvaluationSettings(io_workers=8)
    )


@query
def outputs_written(spark, folder):
    """What a run leaves behind, read back: base outputs, comparisons and the record."""
    out, log, runs = work_path(spark, "results"), work_path(spark, "log"), work_path(spark, "runs")
    rows = fixtures.pairs(spark, folder)
    experiment.run_experiment(rows, stub_experiment(), out, log, runs)
    base = spark.read.parquet(out).filter("engine = 'base'").groupBy(F.lit("base").alias("kind")).agg(F.count("generated_solution").alias("n"))
    compared = experiment_log.read_comparisons(spark, log, rows.select(*TURN_KEY).schema).groupBy(
        F.concat(F.lit("compared "), "evaluation_type").alias("kind")
    ).agg(F.count("raw").alias("n"))
    record = spark.read.json(runs).groupBy(F.concat(F.lit("run "), "status").alias("kind")).agg(F.count("*").alias("n"))
    return experiment.bag_union([base, compared, record])


@query
def outputs_values(spark, folder):
    """The same, value by value: base answers and judge responses as they were written."""
    out, log = work_path(spark, "results"), work_path(spark, "log")
    rows = fixtures.pairs(spark, folder)
    experiment.run_experiment(rows, stub_experiment(), out, log)
    base = spark.read.parquet(out).filter("engine = 'base'").select(F.lit("base").alias("kind"), *TURN_KEY, F.col("generated_solution").alias("text"))
    compared = experiment_log.read_comparisons(spark, log, rows.select(*TURN_KEY).schema)
    return base.unionByName(compared.select(F.col("evaluation_type").alias("kind"), *TURN_KEY, F.col("raw").alias("text")))


@query
def experiment_counts(spark, folder):
    """Experiments per evaluation type in a log of two runs."""
    log, rows = work_path(spark, "log"), fixtures.responses(spark, folder)
    for run in ("first", "second"):
        for kind in ENGINES:
            own = rows.filter(F.col("evaluation_type") == kind).drop("evaluation_type")
            experiment_log.append_experiment(own, log, f"{run}-{kind}", kind, "results", LOG_TIME)
    return experiment_log.experiment_count(experiment_log.read_experiments(spark, log))
