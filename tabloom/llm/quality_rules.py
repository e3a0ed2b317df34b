"""Quality rules whose cutoffs come with a guarantee.

Each rule compares one figure of a text with a cutoff. The cutoffs a rule may take are fixed beforehand. For every
stratum, rule and cutoff, the labelled good documents that the cutoff would reject are counted, and the exact
binomial probability of so few rejections is taken under a true rate of ``risk / rules``. A cutoff is certified if that
probability is at most ``delta`` divided by the number of strata times rules (Bonferroni; the cutoffs of a rule
are tested in a fixed sequence). The strictest certified cutoff of each rule is used; without one the rule is silent
in that stratum. So with probability 1 - ``delta`` no stratum loses more than ``risk`` of its good documents to
the rules.

All labels and all documents count. Thresholds are a row per stratum and rule. Only DataFrame expressions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import blank_words
from tabloom.session import materialize

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
SHINGLE = 5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``figure > cutoff * base``; ``cutoffs`` run from strict to lenient."""

    name: str
    figure: str
    base: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3)),
    Rule("repeats", "n_repeat_words", "n_words", (0.06, 0.08, 0.1, 0.12, 0.15, 0.18)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0.2, 0.25, 0.3, 0.4, 0.5, 0.6)),
    Rule("long_words", "word_chars", "n_words", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    Rule("marks", "n_marks", "n_words", (0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
)


def measured(docs: DataFrame, kept: list[Column | str], text: str = "text") -> DataFrame:
    """``_row``, a struct of the ``kept`` columns, and the struct ``_f`` of figures of the text; null has no words.

    ``n_repeat_words`` counts words inside 5-word windows that occur twice or more in the text. Windows are compared
    by their hashes; only where a hash repeats are they sorted with their positions, and those equal to a neighbour
    in that order laid over each other by position. ``n_lines`` counts lines with a word, ``n_marks``
    exclamation marks and bars.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    first = docs.select(F.struct(*kept).alias("_row"), body.alias("_body"), F.transform(blank_words(F.col(text).cast("string")), lambda w: F.xxhash64(w)).alias("_h"))
    window = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)])
    count = F.size("_h")
    second = first.withColumn(
        "_w", F.when(count >= SHINGLE, F.transform(F.sequence(F.lit(0), count - SHINGLE), window)).otherwise(F.array().cast("array<bigint>"))
    ).withColumn("_lines", F.filter(F.split("_body", "\n"), lambda line: F.trim(F.translate(line, WHITE, " ")) != ""))
    order = F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    twins = F.filter(
        F.col("_o"),
        lambda o, i: (F.get("_o", i - 1)["w"] == o["w"]) | (F.get("_o", i + 1)["w"] == o["w"]),
    )
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(SHINGLE), i + SHINGLE - acc["to"])).alias("n"), (i + SHINGLE).alias("to"))
    spread = F.aggregate(
        F.sort_array(F.transform(twins, lambda o: o["i"])), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"]
    )
    third = second.withColumn(
        "_o", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), order)
    ).withColumn("_repeats", F.when(F.col("_o").isNotNull(), spread).otherwise(0))
    plain = F.length(F.translate("_body", WHITE, ""))
    figures = F.struct(
        count.cast("long").alias("n_words"), plain.cast("long").alias("word_chars"),
        (F.length("_body") - F.length(F.translate("_body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeats").cast("long").alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_body") - F.length(F.translate("_body", "!|", ""))).cast("long").alias("n_marks"),
    )
    return third.select("_row", figures.alias("_f"))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def beyond(f: Column, rule: Rule, cutoff: Column) -> Column:
    return f[rule.figure] > cutoff * f[rule.base]


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by eight so that it is exact to about twelve digits for every n."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    shift = sum((F.log(n.cast("double") + k) for k in range(1, 9)), F.lit(0.0))
    return series - shift


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), for k up to n * rate.

    Summed downwards from k; terms fall off there, and those more than fourteen deviations away add nothing.
    """
    spread = F.ceil(14 * F.sqrt(n * (rate * (1 - rate))) + 40)
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    ratio = lambda i: F.log(i.cast("double")) - F.log((n - i + 1).cast("double")) + math.log1p(-rate) - math.log(rate)
    step = lambda acc, i: F.struct((acc["t"] + ratio(i)).alias("t"), (acc["s"] + F.exp(acc["t"] + ratio(i))).alias("s"))
    low = F.greatest(k - spread, F.lit(0))
    down = F.when(k > low, F.sequence(k, low + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(down, F.struct(top.alias("t"), F.exp(top).alias("s")), step, lambda acc: F.least(acc["s"], F.lit(1.0)))


def certified(figures: DataFrame, labels: DataFrame, risk: float, delta: float, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``stratum`` and per rule its strictest certified cutoff, or null.

    ``figures`` has ``doc_id, stratum, _f``; labels are ``doc_id, quality``, of which 1 is good. A label repeated
    for a document counts once; a document repeated counts as often as it is there. Cutoffs of a rule are
    tested in a fixed order from lenient to strict up to the first that fails, which needs no correction within the
    rule; stricter cutoffs reject no fewer, so the strictest that passes has all before it passed.
    """
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).distinct()
    held = figures.join(good, F.col("doc_id") == F.col("_id"), "left_semi").filter(~base_failed(F.col("_f")))
    tests = [(rule, cutoff, f"_{rule.name}_{i}") for rule in rules for i, cutoff in enumerate(rule.cutoffs)]
    rejected = [F.count_if(beyond(F.col("_f"), rule, F.lit(cutoff))).alias(name) for rule, cutoff, name in tests]
    counts = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *rejected), "holdout-counts")
    rows = F.explode(F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.lit(cutoff).alias("cutoff"), F.col(name).alias("k")) for rule, cutoff, name in tests
    ]))
    rate, level = risk / len(rules), delta / (max(1, counts.count()) * len(rules))
    tested = counts.select("stratum", "n", rows.alias("t")).select("stratum", "n", "t.*").filter(F.col("k") <= F.floor(F.col("n") * rate))
    passed = tested.filter(binomial_tail(F.col("k"), F.col("n"), rate) <= level)
    strictest = [F.min(F.when(F.col("rule") == rule.name, F.col("cutoff"))).alias(f"cutoff_{rule.name}") for rule in rules]
    return passed.groupBy("stratum").agg(*strictest)


def judged(docs: DataFrame, labels: DataFrame, kept: list[str] | None = None, risk: float = 0.05, delta: float = 0.05, stratum: str = "lang") -> DataFrame:
    """``_row, _f, base_failed, kept``: each row of ``docs`` as a struct of its ``kept`` columns, figures and verdict.

    Null strata are one of their own; a stratum without enough good labels keeps all that the base keeps; null and
    empty texts fail the base; repeated rows are judged each; an empty table gives no rows.
    """
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    inner = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if kept is None else kept)])
    narrow = [F.col("doc_id").alias("doc_id"), name.alias("stratum"), inner.alias("row")]
    figures = materialize(measured(docs, narrow), "figures")
    cutoffs = certified(figures.select("_row.doc_id", "_row.stratum", "_f"), labels, risk, delta)
    joined = figures.join(cutoffs, F.col("_row.stratum") == F.col("stratum"), "left")
    fails = [F.coalesce(beyond(F.col("_f"), rule, F.col(f"cutoff_{rule.name}")), F.lit(False)) for rule in RULES]
    rejected = fails[0]
    for fail in fails[1:]:
        rejected = rejected | fail
    failed = base_failed(F.col("_f"))
    return joined.select(F.col("_row.row").alias("_row"), "_f", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, the figures of the base, ``base_failed`` and ``kept`` for every row of ``docs``."""
    rows = judged(docs, labels, kept=["doc_id"], **options)
    return rows.select("_row.doc_id", *[f"_f.{f}" for f in FIGURES], "base_failed", "kept")


def passing(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    return judged(docs, labels, **options).filter("kept").select("_row.*")
