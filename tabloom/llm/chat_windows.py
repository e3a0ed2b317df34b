"""Chat formatting in budgeted windows.

Prefix sums of turn tokens place every turn on a token axis of its conversation. The axis is cut into
blocks; a turn belongs to the block in which it starts, so every span is aligned to turns and no span
depends on the one before it. A turn that crosses a block's end joins the span if it fits the slack kept for
that, and else is a span of its own. A window is a span preceded by the conversation's system turn and by the
turns of the last ``history`` tokens before it; what is repeated is never a target again.

Prefix sums are taken per chunk of turns and then over the chunks' totals, so a conversation with a third
of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_map, column, pieces, same
from tabloom.llm.token_counts import TEXT_BLOCK, transducer
from tabloom.session import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CHUNK_TURNS = 1_024
CHARS_PER_TOKEN = 4


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, of its repeated history, and the least a window leaves for new turns."""

    window: int = 1_024
    history: int = 192
    least: int = 256


def escaped(text: Column) -> Column:
    """``<|`` becomes ``<\\|``, and every ``<\\…|`` gets one more backslash, so no marker is left and the way back is exact."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """Roles stand on one line: backslashes and line breaks are spelled out, then markers are escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def counted_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = transducer(path)
    for batch in batches:
        messages = column(batch, "_message")
        counts = [n for start, end in pieces(messages, TEXT_BLOCK) for n in machine.counts(messages[start:end])]
        kept = batch.select([c for c in batch.schema.names if c != "_message"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(counts, pa.int64())], [*kept.schema.names, "tokens"])


def counted(turns: DataFrame, path: str) -> DataFrame:
    """``conv_id, turn, role, text, tokens``: the tokens of every turn as it stands in a window, by the tokenizer of ``path``.

    Role and text are counted together, as escaped; the two markers and the line break after them are a token each.
    """
    narrow = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    body = F.concat(escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"), escaped(F.coalesce("text", F.lit(""))))
    schema = ", ".join(f"{name} {kind}" for name, kind in narrow.dtypes) + ", tokens long"
    rows = arrow_map(narrow.withColumn("_message", body), lambda b: counted_batches(b, path), schema)
    return rows.withColumn("tokens", F.col("tokens") + 3)


def placed_turns(turns: DataFrame, budget: Budget, tokens: Column | None = None) -> DataFrame:
    """Turns with their place: ``conv_id, turn, role, text, at, start, end, system_tokens, is_system``.

    ``start`` and ``end`` are prefix sums of the tokens of a conversation's turns, the system turn aside. ``tokens`` are
    those of a turn, of columns of ``turns``; without them a token is taken to be ``CHARS_PER_TOKEN`` characters.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    given = F.lit(None) if tokens is None else F.coalesce(tokens, F.lit(0))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), given.cast("long").alias("cost"))
    message = F.length(F.lit(OPEN + "\n" + CLOSE)) + F.length("role") + F.length(escaped(F.col("text")))
    cost = F.coalesce("cost", F.ceil(message / CHARS_PER_TOKEN).cast("long"))
    rows = rows.withColumn("cost", cost).withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    own = Window.partitionBy("conv_id", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("cost").over(own)).withColumn("_n", F.count("*").over(own))
    totals = rows.groupBy("conv_id", "chunk").agg(F.sum("cost").alias("_cost"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"),
        F.coalesce(F.sum("_cost").over(earlier), F.lit(0)).alias("_base"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"),
    )
    rows = rows.join(bases, same(F.col("conv_id"), F.col("_c")) & same(F.col("chunk"), F.col("_k"))).select(
        "conv_id", "turn", "role", "text", "cost", (F.col("_first") + F.col("_n") - 1).alias("at"), (F.col("_base") + F.col("_in")).alias("_end")
    )
    return materialize(rows, "placed-turns")


def systems(rows: DataFrame) -> DataFrame:
    """``_c, system, system_tokens``: the first turn of every conversation that begins with a system turn."""
    first = rows.filter((F.col("at") == 0) & (F.col("role") == "system"))
    return first.select(F.col("conv_id").alias("_c"), F.col("text").alias("system"), F.col("cost").alias("system_tokens"))


def spans(rows: DataFrame, budget: Budget) -> DataFrame:
    """Placed turns with the span each belongs to: ``block, own``."""
    lead = systems(rows)
    joined = rows.join(lead.select("_c", "system_tokens"), same(F.col("conv_id"), F.col("_c")), "left").drop("_c")
    system = F.coalesce("system_tokens", F.lit(0))
    room = F.greatest(F.lit(budget.window - budget.history) - system, F.lit(budget.least))
    block_size = F.floor(room * 3 / 4)
    is_system = F.col("system_tokens").isNotNull() & (F.col("at") == 0)
    end = F.when(is_system, 0).otherwise(F.col("_end") - system)
    start = F.when(is_system, 0).otherwise(end - F.col("cost"))
    placed = joined.select("conv_id", "turn", "role", "text", "cost", "at", is_system.alias("is_system"), start.alias("start"), end.alias("end"),
                           block_size.alias("_size"), (room - block_size).alias("_slack"))
    block = F.floor(F.col("start") / F.col("_size"))
    crosses = (F.col("end") > (block + 1) * F.col("_size")) & (F.col("cost") > F.col("_slack"))
    return placed.withColumn("block", block).withColumn("own", crosses.cast("int")).drop("_size", "_slack")


def windows(turns: DataFrame, budget: Budget = Budget(), tokens: Column | None = None) -> DataFrame:
    """``conv_id, block, own, text, repeated, loss, tokens, over_budget``, a row per window, ordered by (block, own).

    ``text`` is the formatted window; its first ``repeated`` messages were in earlier windows; ``loss`` lists the
    code point ranges that are targets: assistant texts that are not repeated. A single turn larger than the
    budget makes a window that is marked ``over_budget``, never cut. Rows are taken by turn, ties by role and
    text; a null turn comes first, null texts and roles are empty, null conversations are one of their own; an
    empty table gives no windows.
    """
    placed = spans(placed_turns(turns, budget, tokens), budget)
    heads = placed.groupBy("conv_id", "block", "own").agg(
        F.min(F.when(~F.col("is_system"), F.col("start"))).alias("from"), F.max("is_system").alias("has_system")
    )
    message = F.struct(F.col("at"), F.col("role"), F.col("text"), F.col("cost")).alias("message")
    new = placed.select("conv_id", "block", "own", F.lit(False).alias("repeated"), message)
    # Windows look for their history in the token bucket of their start and the one before.
    bucket = F.floor(F.col("start") / budget.history)
    sources = placed.filter(~F.col("is_system")).select(
        F.col("conv_id").alias("_c"), bucket.alias("_b"), F.col("start").alias("_start"), message
    )
    later = heads.filter(F.col("from") > 0).select(
        "conv_id", "block", "own", "from",
        F.explode(F.array(F.floor(F.col("from") / budget.history), F.floor(F.col("from") / budget.history) - 1)).alias("_bucket"),
    )
    history = later.join(
        sources,
        same(F.col("conv_id"), F.col("_c")) & (F.col("_bucket") == F.col("_b"))
        & (F.col("_start") < F.col("from")) & (F.col("_start") >= F.col("from") - budget.history),
    ).select("conv_id", "block", "own", F.lit(True).alias("repeated"), "message")
    lead = systems(placed)
    again = heads.filter(~F.col("has_system")).join(lead, same(F.col("conv_id"), F.col("_c"))).select(
        "conv_id", "block", "own", F.lit(True).alias("repeated"),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tokens").alias("cost")).alias("message"),
    )
    every = new.unionByName(history).unionByName(again)
    listed = every.groupBy("conv_id", "block", "own").agg(
        F.sort_array(F.collect_list(F.struct("message.at", "repeated", "message.role", "message.text", "message.cost"))).alias("m")
    )
    body = lambda m: F.concat(F.lit(OPEN), escaped_role(m["role"]), F.lit("\n"), escaped(m["text"]))
    bodies = listed.withColumn("b", F.transform("m", body))
    ends = F.aggregate(
        "b", F.array(F.lit(0).cast("long")),
        lambda ends, b: F.concat(ends, F.array((F.element_at(ends, -1) + F.length(b) + len(CLOSE)).cast("long"))),
    )
    target = lambda m, i: F.struct(
        (F.col("e")[i] + len(OPEN) + 1 + F.length(escaped_role(m["role"]))).cast("long").alias("start"),
        (F.col("e")[i + 1] - len(CLOSE)).cast("long").alias("end"), ((m["role"] == "assistant") & ~m["repeated"]).alias("loss"),
    )
    ready = bodies.withColumn("e", ends).withColumn("t", F.transform("m", target))
    used = F.aggregate("m", F.lit(0).cast("long"), lambda n, m: n + m["cost"])
    return ready.select(
        "conv_id", "block", "own", F.concat(F.array_join("b", CLOSE), F.lit(CLOSE)).alias("text"),
        F.size(F.filter("m", lambda m: m["repeated"])).cast("long").alias("repeated"),
        F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["end"])).alias("loss"),
        used.alias("tokens"), (used > budget.window).alias("over_budget"),
    )


MESSAGE = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose windows follow each other in order; holds one window at a time."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
    done: list[tuple] = []
    open_, state = None, None

    def closed() -> tuple:
        n, turns, chars, loss, formatted, count = state
        return open_[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count

    for batch in batches:
        for conv, text, repeated, loss in zip(*(column(batch, c) for c in ("conv_id", "text", "repeated", "loss"))):
            if open_ != (conv,):
                if open_ is not None:
                    done.append(closed())
                open_, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, content in MESSAGE.findall(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{unescaped_role(role)}\n{unescaped(content)}\n".encode())
            for span in loss:
                target = unescaped(text[span["start"]: span["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
            state[5] += 1
        if len(done) >= 1_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done = []
    if open_ is not None:
        done.append(closed())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """Read windows back into one row of digests per conversation.

    A digest runs over the conversation in order, so its windows stream through one task; the task keeps two
    hash states and one window.
    """
    ordered = formatted.select("conv_id", "block", "own", "text", "repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "block", "own")
    return arrow_map(ordered, read_back, DIGEST)
