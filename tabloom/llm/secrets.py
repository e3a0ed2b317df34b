"""Secret scan with a conditional random field beside fixed patterns.

The patterns, the base, are always reported. The field tags the tokens of a line as secret begin, inside or outside.
It sees the shape of a token, the shapes of its neighbours, the names before and behind it, and the kind of file. Names are
taken apart at signs and at changes of case, and their parts are hashed. The field learns from lines of the corpus in which
the patterns found something, from lines with digits or equals signs in which they did not, and from other lines, a
bounded sample of each. A sampled line comes as the tokens around what was found, so it may have any length, with the
kind of its file. So the field marks strings that look and stand like secrets where no pattern fits.

All tokens of all texts are scored. Stretches that the trained weights prove to be outside are not decoded.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import crf
from tabloom.llm.common import LOWER_BYTES, arrow_map, column, pieces
from tabloom.session import materialize

# The patterns of the base and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
# Names of credentials as a neighbouring word may spell them.
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials", "private", "access")
# The bounded sample of lines, of each class, that the field learns from, and the tokens taken around what is found in one.
TRAINING_LINES, TRAINING_TOKENS = 1_500, 48
ODD_LINE = re.compile("[0-9=]|AKIA|[a-f]{16}")
CLASSES = ("found", "odd", "other")
# Parts of names: capitals, a word, or a letter beyond ASCII.
PART = re.compile(r"[A-Z]{2,}(?![a-z])|[A-Z]?[a-z]+|[^\x00-\x7F]")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
TOKEN_OR_BREAK = re.compile(TOKEN.pattern + r"|\n")
LONG_LETTERS = 24
SHAPES, FILES = 24, 3
# Shapes that can never be part of a secret: none.
PLAIN = ()
TEXT_BLOCK = 3_000_000
IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
IS_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)) + [9, 10, 13, 32] + list(range(128, 256)))


def shape(token: str) -> int:
    """The number of a token's shape; 0 is kept for the ends of a line."""
    size = len(token)
    if token.lower().strip("-_/+") in NAMES:
        return 1
    if size == 1 and not token.isalnum():
        return {"=": 2, ":": 3, '"': 4, "'": 4, "`": 4}.get(token, 5)
    digits, letters = any(c in "0123456789" for c in token), any(map(str.isalpha, token))
    if not digits:
        if size >= LONG_LETTERS:
            return 22
        return 6 if token.islower() else 8 if token.isupper() else 7 if token[0].isupper() and token[1:].islower() else 9
    if not letters:
        return 10 if size < 8 else 11 if size < 16 else 12
    if token.startswith("AKIA"):
        return 21
    if all(c in "0123456789abcdef" for c in token):
        return 13 if size < 16 else 14
    if all(c in "0123456789ABCDEF" for c in token):
        return 15 if size < 16 else 16
    if size >= 16 and any(c in "+/_-" for c in token):
        return 20
    return 17 if size < 12 else 18 if size < 20 else 19


def name_buckets(token: str) -> list[int]:
    """Buckets of the parts of a name; none for signs, numbers and single ASCII letters."""
    parts = {m.lower() for m in PART.findall(token) if len(m) > 1 or m.isalpha() and not m.isascii()}
    return sorted({xxhash.xxh3_64_intdigest(m) % crf.BUCKETS for m in parts})


def near_names(named: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """For each place in ``crf.NEAR`` and token of a stream, where the name is that stands there in the same line, or -1."""
    size, at = len(named), np.arange(len(named))
    line = np.maximum.accumulate(np.where(breaks, at, -1))
    last = np.concatenate(([-1], np.maximum.accumulate(np.where(named, at, -1))[:-1]))
    last = np.where(last > line, last, -1)
    second = np.where(last >= 0, last[last], -1)
    end = np.concatenate((np.minimum.accumulate(np.where(breaks, at, size)[::-1])[::-1], [size]))
    following = np.concatenate((np.minimum.accumulate(np.where(named, at, size)[::-1])[::-1], [size]))[1:]
    return np.stack([last, second, np.where(following < end[:-1], following, -1)])


class Shapes(dict):
    """Numbers of the tokens met, with their shapes and what the names they spell score; forgotten when too many.

    Number 0 is a line break, which also stands for no name.
    """

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        self["\n"] = 0
        self.shape, self.buckets, self.model = [0], [[]], None
        self.tables = np.zeros(1, np.int64), np.zeros(1, bool), np.zeros((len(crf.NEAR), 1, crf.TAGS))

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self.shape)
        self.shape.append(shape(token))
        self.buckets.append(name_buckets(token))
        return number

    def scored(self, model: crf.Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By number the shape, whether it is a name, and its scores by place."""
        shapes, named, scores = self.tables
        known = len(shapes) if self.model is model else 0
        new = self.buckets[known:]
        if new:
            owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, new), np.int64, len(new)))
            flat = np.fromiter(itertools.chain.from_iterable(new), np.int64, len(owner))
            more = np.stack([crf.added(model.tables[name][flat], owner, len(new)) for name in crf.NEAR])
            self.tables = (
                np.concatenate((shapes[:known], self.shape[known:])), np.concatenate((named[:known], np.fromiter(map(bool, new), bool, len(new)))),
                np.concatenate((scores[:, :known], more), axis=1),
            )
            self.model = model
        return self.tables


def base_spans(text: str, low: bytes, codes: np.ndarray) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the patterns' matches, in order; checks on bytes skip texts that cannot match."""
    found = []
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"akia" in low:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if longest(IS_HEX, codes) >= LEAST_HEX:
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def longest(inside: np.ndarray, codes: np.ndarray) -> int:
    """The longest run of bytes of a class."""
    breaks = np.flatnonzero(~inside[codes])
    return int(np.diff(np.concatenate(([-1], breaks, [len(codes)]))).max()) - 1


def file_kind(codes: np.ndarray) -> int:
    """0 to 2 by the share of digits and signs in the file."""
    share = 1 - IS_LETTER[codes].mean() if len(codes) else 0
    return 0 if share < 0.04 else 1 if share < 0.12 else 2


def field_spans(texts: list[str], lows: list[bytes], codes: list[np.ndarray], model: crf.Field, shapes: Shapes, whole: bool = False) -> list[list[tuple[int, int]]]:
    """Spans that the field tags as secrets, per text; ``whole`` decodes every token, to the same end."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(shapes) > 200_000:
        shapes.reset()
    # One stream of all texts, in which line breaks, of number and shape 0, also part texts.
    rows = [[*map(shapes.__getitem__, TOKEN_OR_BREAK.findall(text)), 0] for text in texts]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    if not sizes.sum():
        return found
    stream = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(sizes.sum()))
    kinds = np.repeat(np.fromiter(map(file_kind, codes), np.int64, len(codes)), sizes)
    breaks = stream == 0
    shape_of, named, spelled = shapes.scored(model)
    places = near_names(named[stream], breaks)
    emit = model.stream_emissions(shape_of[stream], kinds, spelled, np.where(places >= 0, stream[places], 0))
    wanted = ~breaks if whole else crf.open_tokens(model, emit) & ~breaks
    # The token behind an open stretch is outside; with it goes the score of leaving.
    wanted[1:] |= wanted[:-1] & ~breaks[1:]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], wanted, [False])).astype(np.int8))).reshape(-1, 2)
    tags = np.zeros(len(stream), np.int64)
    for (first, last), row in zip(edges, crf.best_tags(model, [emit[a:b] for a, b in edges])):
        tags[first:last] = row
    ends = np.cumsum(sizes)
    tagged = np.flatnonzero(tags)
    for n in np.unique(np.searchsorted(ends, tagged, "right")):
        own, open_ = tags[ends[n] - sizes[n]: ends[n]], None
        for m, tag in zip(TOKEN_OR_BREAK.finditer(texts[n]), own.tolist()):
            if tag != crf.INSIDE and open_:
                found[n].append(open_)
                open_ = None
            if tag == crf.BEGIN:
                open_ = m.span()
            elif tag == crf.INSIDE:
                open_ = (open_[0] if open_ else m.start(), m.end())
        if open_:
            found[n].append(open_)
    return found


def joined(base: list[tuple[int, int, str]], more: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Base spans, and those of the field, whole, that do not lie inside what base spans cover."""
    runs: list[list[int]] = []
    for start, end, _ in sorted(base):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    firsts = [start for start, _ in runs]
    new = []
    for start, end in more:
        at = bisect.bisect_right(firsts, start) - 1
        if at < 0 or end > runs[at][1]:
            new.append((start, end, "crf"))
    return sorted(base + new, key=lambda s: (s[0], KINDS.index(s[2])))


def token_row(tokens: list[str]) -> crf.Row:
    """Shapes and near names of the tokens of a line."""
    buckets = [name_buckets(t) for t in tokens]
    places = near_names(np.array(list(map(bool, buckets)), bool), np.zeros(len(tokens), bool)) if tokens else np.empty((len(crf.NEAR), 0), int)
    return crf.Row([shape(t) for t in tokens], [[buckets[p] if p >= 0 else [] for p in column] for column in places.T.tolist()])


def training_row(line: str, base: list[tuple[int, int, str]]) -> tuple[crf.Row, list[int]]:
    """Shapes with near names, and tags, of the tokens around what the base finds in a line, or of its first tokens."""
    spans = [(ASSIGN.match(line, start).start(2) if kind == "assign" else start, end) for start, end, kind in base]
    tokens = list(TOKEN.finditer(line))
    tag, last, at = [], None, 0
    for token in tokens:
        while at < len(spans) and spans[at][1] <= token.start():
            at += 1
        span = next((s for s in spans[at: at + len(KINDS)] if token.start() < s[1] and s[0] < token.end()), None)
        tag.append(crf.OUTSIDE if span is None else crf.INSIDE if span == last else crf.BEGIN)
        last = span
    first = max(0, next((n for n, t in enumerate(tag) if t), 0) - TRAINING_TOKENS // 2)
    row = token_row([t[0] for t in tokens])
    part = slice(first, first + TRAINING_TOKENS)
    return crf.Row(row[part], row.names[part]), tag[part]


def training_rows(lines: list[str]) -> tuple[list[crf.Row], list[list[int]], list[int]]:
    """Rows, tags and file kinds of lines that are files of their own."""
    rows, tags, kinds = [], [], []
    for line in lines:
        codes = np.frombuffer(line.encode(), np.uint8)
        row, tag = training_row(line, base_spans(line, line.encode().translate(LOWER_BYTES), codes))
        if row:
            rows.append(row)
            tags.append(tag)
            kinds.append(file_kind(codes))
    return rows, tags, kinds


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``class, hash, row``: in each class the ``TRAINING_LINES`` distinct lines of least hash with the kind of their file."""
    least: list[list[int]] = [[] for _ in CLASSES]
    held: list[dict[int, str]] = [{} for _ in CLASSES]
    bound = [np.iinfo(np.int64).max] * len(CLASSES)
    for batch in batches:
        for text in filter(None, column(batch, "text")):
            codes = np.frombuffer(text.encode(), np.uint8)
            kind, found = file_kind(codes), base_spans(text, text.encode().translate(LOWER_BYTES), codes)
            at = start = 0
            for line in text.split("\n"):
                end, own = start + len(line), at
                while at < len(found) and found[at][0] < end:
                    at += 1
                if line and not line.isspace():
                    value = xxhash.xxh3_64_intdigest(line, kind) >> 1
                    if at > own or value < max(bound[1:]):
                        group = 0 if at > own else 1 if ODD_LINE.search(line) else 2
                        if value < bound[group] and value not in held[group]:
                            row, tag = training_row(line, [(s - start, e - start, k) for s, e, k in found[own:at]])
                            held[group][value] = json.dumps([row, row.names, tag, kind])
                            heapq.heappush(least[group], -value)
                            if len(least[group]) > TRAINING_LINES:
                                del held[group][-heapq.heappop(least[group])]
                            if len(least[group]) == TRAINING_LINES:
                                bound[group] = -least[group][0]
                start = end + 1
    for group, rows in enumerate(held):
        yield pa.RecordBatch.from_arrays(
            [pa.array([group] * len(rows), pa.int32()), pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.string())], ["class", "hash", "row"]
        )


def trained_field(docs: DataFrame) -> crf.Field:
    """The field, learned from at most ``TRAINING_LINES`` distinct lines of each class, those of least hash."""
    lines = materialize(arrow_map(docs.select("text"), sampled, "class int, hash long, row string"), "training-lines")
    lines = lines.dropDuplicates(["class", "hash"])
    parts = [lines.filter(F.col("class") == n).orderBy("hash").limit(TRAINING_LINES) for n in range(len(CLASSES))]
    sample = [json.loads(r["row"]) for r in parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("class", "hash").collect()]
    rows = [crf.Row(shapes, names) for shapes, names, _, _ in sample]
    return crf.trained(rows, [tags for _, _, tags, _ in sample], [kind for *_, kind in sample], SHAPES, FILES)


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def found_spans(texts: list[str], model: crf.Field, shapes: Shapes) -> list[tuple[list, list]]:
    lows = [t.encode().translate(LOWER_BYTES) for t in texts]
    codes = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    base = [base_spans(t, low, code) for t, low, code in zip(texts, lows, codes)]
    more = field_spans(texts, lows, codes, model, shapes)
    return [(b, joined(b, m)) for b, m in zip(base, more)]


def scanned(batches: Iterator[pa.RecordBatch], model: crf.Field) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        for start, end in pieces(column(batch, "text"), TEXT_BLOCK):
            part = batch.slice(start, end - start)
            results = found_spans([t or "" for t in column(part, "text")], model, shapes)
            counts = [[sum(k == kind for _, _, k in base) for base, _ in results] for kind in KINDS[:3]]
            yield pa.RecordBatch.from_arrays([
                part.column(0), *[pa.array(c, pa.int64()) for c in counts],
                pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in results]),
                pa.array([spelled(spans) for _, spans in results]),
            ], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``.

    Null and empty texts hold nothing; null ids pass through; repeated rows are scanned each; a corpus in which
    the patterns find nothing trains a field that adds nothing; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = trained_field(narrow)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return arrow_map(narrow, lambda b: scanned(b, model), schema)


def masked(text: str | None, spans: list[tuple[int, int, str]], mark: str) -> str | None:
    if not spans:
        return text
    kept, last = [], 0
    for start, end, _ in spans:
        if start >= last:
            kept += [text[last:start], mark]
        last = max(last, end)
    return "".join([*kept, text[last:]])


def masked_batches(batches: Iterator[pa.RecordBatch], model: crf.Field, mark: str) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for start, end in pieces(column(batch, "text"), TEXT_BLOCK):
            part = batch.slice(start, end - start)
            texts = column(part, "text")
            results = found_spans([t or "" for t in texts], model, shapes)
            new = pa.array([masked(t, spans, mark) for t, (_, spans) in zip(texts, results)], pa.string())
            yield part.set_column(at, part.schema.field(at).name, new)


def mask(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by ``mark``; spans that overlap are one."""
    typed = docs.withColumn("text", F.col("text").cast("string"))
    model = trained_field(typed)
    return arrow_map(typed, lambda b: masked_batches(b, model, mark), typed.schema)
