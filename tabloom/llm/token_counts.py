"""Token counts by a compiled finite-state transducer.

A piece model merges neighbouring symbols by score. Its encoding of a text can be read from left to right: the
last piece of every prefix is the one piece that ends there and is left alone beside the piece before it. So
the only memory needed is which beginnings of pieces are still open, the last piece before each of them, and
how the counts at these places differ from the count now. That is finite, and it is the state of a
deterministic transducer whose transitions carry the change of the token count. The transducer is
compiled from the vocabulary as states are met, and kept between the tasks of a worker.

Texts are cut into chunks of equal length that run side by side. A chunk's state map is constant from its first
word start on, because no piece reaches across one: that part is run at once for all chunks. The part before
it is applied to the exit state of the chunk before. So maps compose in a scan over a text's chunks, and the
counts add up in prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tabloom.llm.common import arrow_map, column, pieces, starts_of

SPACE = "▁"
CHUNK = 256
TEXT_BLOCK = 3_000_000
# Characters with a column of their own in the transition table; others go through a dictionary.
COLUMNS = 128
STATES = 200_000
# Below a node with at most so many pieces, a state names those that are still possible instead of the piece before.
NAMED = 24
# Answers kept on whether two pieces stay side by side.
REMEMBERED = 1_000_000
FEW = 4
ROOT, NONE = 0, -1
# A transition packs the next state's row above the change of the count plus a bias.
SHIFT, BIAS = 6, 32
NORMAL = 1


class PieceModel:
    """The pieces of a byte-fallback BPE model with their scores, and encoding of short strings."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as raw:
            model.ParseFromString(raw.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalization is needed")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces must not reach across word starts")

    def merged(self, text: str) -> list[str]:
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                value = score.get(parts[i] + parts[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """States and transitions as far as they have been met; rows of the table are states, columns characters."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [NONE]
        self.names: list[str] = []
        self.weights: list[int] = []
        for piece in sorted(model.score):
            self.add(piece, 1)
        for char in {c for piece in model.score for c in piece} - set(model.score):
            self.add(char, len(char.encode()))
        self.below: list[frozenset[int] | None] = [frozenset()] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            under = [self.below[child] for child in self.children[node].values()]
            own = [self.token[child] for child in self.children[node].values() if self.token[child] != NONE]
            if None not in under and sum(map(len, under)) + len(own) <= NAMED:
                self.below[node] = frozenset(own).union(*under)
            else:
                self.below[node] = None
        self.alone: dict[tuple[int, int], bool] = {}
        self.column_of: dict[str, int] = {}
        self.columns: list[str | int] = [1, 2, 3, 4]
        self.classes = np.repeat(np.array([0, 1, 2], np.int16), [0x80, 0x800 - 0x80, 0x10000 - 0x800])
        self.seen = np.zeros(0x10000, bool)
        for char in (SPACE,):
            self.assign(char)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.row_of: dict[tuple, int] = {}
        self.table = np.full((1024, COLUMNS), -1, np.int32)
        self.rare: dict[tuple[int, str], int] = {}
        self.start = self.intern((((ROOT, NONE, 0),), False))

    def add(self, piece: str, weight: int) -> None:
        node = ROOT
        for char in piece:
            node = self.children[node].setdefault(char, len(self.children))
            if node == len(self.children):
                self.children.append({})
                self.token.append(NONE)
        self.token[node] = len(self.names)
        self.names.append(piece)
        self.weights.append(weight)

    def intern(self, state: tuple) -> int:
        row = self.row_of.get(state)
        if row is None:
            row = self.row_of[state] = len(self.states)
            self.states.append(state)
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return row

    def stand_alone(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are."""
        if left == NONE:
            return True
        known = self.alone.get((left, right))
        if known is None:
            if len(self.alone) > REMEMBERED:
                self.alone.clear()
            pair = [self.names[left], self.names[right]]
            known = self.alone[left, right] = self.model.merged("".join(pair)) == pair
        return known

    def possible(self, before: int | frozenset[int], token: int) -> bool:
        return token in before if isinstance(before, frozenset) else self.stand_alone(before, token)

    def step(self, row: int, char: str | int) -> int:
        """The packed transition of a state by a character, or by the byte length of one that is in no piece."""
        if isinstance(char, int):
            return self.start << SHIFT | char + BIAS
        entries, spaces = self.states[row]
        if char == SPACE and not spaces:
            entries = ((ROOT, NONE, 0),)
        alive, last, count = [], NONE, 0
        for node, before, offset in entries:
            child = self.children[node].get(char)
            if child is None:
                continue
            token = self.token[child]
            if token != NONE and last == NONE and self.possible(before, token):
                last, count = token, offset + self.weights[token]
            below = self.below[child]
            if below is not None:
                before = below & before if isinstance(before, frozenset) else frozenset(t for t in below if self.stand_alone(before, t))
            if before != frozenset():
                alive.append((child, before, offset))
        new = tuple((node, before, offset - count) for node, before, offset in alive) + ((ROOT, last, 0),)
        return self.intern((new, char == SPACE)) << SHIFT | count + BIAS

    def assign(self, char: str) -> None:
        """Give a character of the vocabulary a column while there is room."""
        self.seen[ord(char)] = True
        if char in self.children[ROOT]:
            if len(self.columns) < COLUMNS:
                self.column_of[char] = self.classes[ord(char)] = len(self.columns)
                self.columns.append(char)
            else:
                self.classes[ord(char)] = COLUMNS

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        """The column of every character; ``COLUMNS`` for those without one."""
        low = np.minimum(codes, 0xFFFF)
        for code in np.unique(low[~self.seen[low]]):
            self.seen[code] = True
            if code < 0xFFFF:
                self.assign(chr(code))
        found = self.classes[low]
        if codes.max(initial=0) >= 0xFFFF:
            high = codes >= 0xFFFF
            known = np.array([chr(c) in self.children[ROOT] for c in codes[high]], bool)
            found[high] = np.where(known, COLUMNS, np.where(codes[high] > 0xFFFF, 3, 2))
        return found

    def transition(self, row: int, kind: int, char: str) -> int:
        if kind == COLUMNS:
            packed = self.rare.get((row, char))
            if packed is None:
                packed = self.rare[row, char] = self.step(row, char)
            return packed
        packed = int(self.table[row, kind])
        if packed < 0:
            packed = self.step(row, self.columns[kind])
            self.table[row, kind] = packed
        return packed

    def run(self, codes: np.ndarray, kinds: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of stretches of text that start in the given states."""
        order = np.argsort(-size, kind="stable")
        at, left, rows = begin[order], -size[order], rows[order].copy()
        counts = np.zeros(len(order), np.int64)
        for step in range(int(size.max(initial=0))):
            k = int(np.searchsorted(left, -step))
            here = at[:k] + step
            kind = kinds[here]
            if k <= FEW:
                packed = np.array([self.transition(int(r), int(c), chr(x)) for r, c, x in zip(rows[:k], kind, codes[here])])
            else:
                rare = kind == COLUMNS
                packed = self.table[rows[:k], np.where(rare, 0, kind)]
                odd = np.flatnonzero((packed < 0) | rare)
                if len(odd):
                    packed = packed.copy()
                    for n in odd:
                        packed[n] = self.transition(int(rows[n]), int(kind[n]), chr(codes[here[n]]))
            rows[:k] = packed >> SHIFT
            counts[:k] += (packed & (1 << SHIFT) - 1) - BIAS
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return rows[back], counts[back]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > STATES:
            self.reset()
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        kinds = self.classes_of(codes)
        bounds = starts_of(map(len, marked))
        # Chunks, each with the text it belongs to.
        per_text = -(-np.diff(bounds) // CHUNK)
        text = np.repeat(np.arange(len(texts)), per_text)
        begin = bounds[text] + CHUNK * (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        end = np.minimum(begin + CHUNK, bounds[text + 1])
        # Word starts, among them the start of every text.
        space = kinds == self.column_of[SPACE]
        first = space & ~np.concatenate(([False], space[:-1]))
        first[bounds[:-1][per_text > 0]] = True
        resets = np.append(np.flatnonzero(first), len(codes))
        tail = np.minimum(resets[np.searchsorted(resets, begin)], end)
        exits, total = self.run(codes, kinds, tail, end - tail, np.full(len(text), self.start))
        head = tail - begin
        waiting = np.flatnonzero(head > 0)
        closed = head < end - begin
        while len(waiting):
            ready = closed[waiting - 1]
            now = waiting[ready]
            states, counts = self.run(codes, kinds, begin[now], head[now], exits[now - 1])
            total[now] += counts
            whole = ~closed[now]
            exits[now[whole]] = states[whole]
            closed[now[whole]] = True
            waiting = waiting[~ready]
        sums = np.concatenate(([0], np.cumsum(total)))
        ends = np.cumsum(per_text)
        return sums[ends] - sums[ends - per_text]


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of this worker process."""
    if path not in _transducers:
        _transducers[path] = Transducer(PieceModel(path))
    return _transducers[path]


def count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    machine = transducer(path)
    for batch in batches:
        texts = [t or "" for t in column(batch, "text")]
        for start, end in pieces(texts, TEXT_BLOCK):
            counts = machine.counts(texts[start:end])
            sizes = pa.array([len(t.encode()) for t in texts[start:end]], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), sizes, pa.array(counts, pa.int64()), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def count_tokens(docs: DataFrame, path: str, limit: int = 4_096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null counts as empty, which has no tokens; strings of special tokens are ordinary text; null ids pass
    through; repeated rows are counted each; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(narrow, lambda b: count_batches(b, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
