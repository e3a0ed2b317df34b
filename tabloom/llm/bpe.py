"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside partitions.

A partition splits its texts into words by the tokenizer's pattern. The words it has not met yet go to a
DuckDB query in blocks: a row is a token at a position of a word together with the token after it, joined
with the merge table for the pair's rank. Every step of the recursion contracts each word's leftmost pair of
minimum rank and joins the two pairs which that changes; it ends when no word has a pair left to merge.
Decoding joins token positions with the vocabulary and aggregates the pieces in the order of positions. A text's ids are
those of its words one after another, so each word's ids are decoded once, by that query, and a text is its words' bytes joined.

The merge table holds every way to split a token into two tokens; its size depends on the vocabulary alone.
Memory is bounded by a block of words, one text and the kept words, which are dropped when too many. A
word longer than a piece is encoded piece by piece; neighbouring pieces are joined by encoding the tokens
around the seam again, more of them until the outermost ones come out unchanged. That is exact, because a
sequence of tokens is the encoding of its bytes as soon as each two neighbours encode to themselves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_map, pieces

BLOCK_BYTES = 300_000
PIECE_BYTES = 128
SEAM_TOKENS = 8
KEPT_WORDS = 1_000_000
TEXT_BLOCK = 1_000_000
MEMORY = "256MB"
# A pair's key, and the place of a rank above a position, in one integer each.
PAIR, PLACE = 1 << 16, 1 << 40
SETUP = """
CREATE TABLE merges AS SELECT pair, made::INTEGER AS made FROM merge_rows;
CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows;
"""
# Whole numbers of 32 bits, as they are rewritten in every step. A row: word, position of a token, the token, the token after it (-1: none) with its position, and the
# rank of the pair, which is also the id of what it makes (null: no merge).
ENCODE = f"""
WITH RECURSIVE state AS (
    SELECT 0::INTEGER AS step, s.w, s.pos, s.a, s.b, (s.pos + 1)::INTEGER AS next, m.made
    FROM symbols s LEFT JOIN merges m ON m.pair = s.a::BIGINT * {PAIR} + s.b
    UNION ALL
    SELECT n.step, n.w, n.pos, n.a, n.b, n.next, CASE WHEN n.changed THEN m.made ELSE n.made END
    FROM (
        SELECT (s.step + 1)::INTEGER AS step, s.w, s.pos, s.made,
            CASE WHEN s.pos = k.pos THEN k.made ELSE s.a END AS a,
            CASE WHEN s.pos = k.pos THEN k.after ELSE CASE WHEN s.next = k.pos THEN k.made ELSE s.b END END AS b,
            CASE WHEN s.pos = k.pos THEN k.after_pos ELSE s.next END AS next,
            s.pos = k.pos OR s.next = k.pos AS changed
        FROM state s JOIN (
            SELECT g.w, g.pos, g.made, r.pos AS gone, r.b AS after, r.next AS after_pos
            FROM (
                SELECT w, (best // {PLACE})::INTEGER AS made, (best % {PLACE})::INTEGER AS pos
                FROM (SELECT w, min(made::BIGINT * {PLACE} + pos) AS best FROM state WHERE made IS NOT NULL GROUP BY w)
            ) g
            JOIN state l ON l.w = g.w AND l.pos = g.pos
            JOIN state r ON r.w = g.w AND r.pos = l.next
        ) k ON k.w = s.w AND k.gone <> s.pos
    ) n LEFT JOIN merges m ON n.changed AND m.pair = n.a::BIGINT * {PAIR} + n.b
)
SELECT s.w, list(s.a ORDER BY s.pos) AS ids
FROM state s JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) e ON e.w = s.w AND e.step = s.step
GROUP BY s.w ORDER BY s.w
"""
DECODE = """
SELECT t.w, string_agg(v.piece, '' ORDER BY t.pos) AS piece
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM lists) t JOIN vocabulary v ON v.id = t.id
GROUP BY t.w ORDER BY t.w
"""
# White space as the tokenizer's library knows it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters and numbers below U+0100, for the faster pattern over texts without any other characters.
LETTERS, NUMBERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordSplitter:
    """Matches of the tokenizer's pattern; two forms of one pattern, the first for texts below U+0100."""

    def __init__(self, pattern: str) -> None:
        spaced = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{SPACE}\\p{{L}}\\p{{N}}]").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
        self.any = regex.compile(spaced, regex.V0).findall
        latin = spaced.replace(f"[^{SPACE}\\p{{L}}\\p{{N}}]", f"[^{SPACE}{LETTERS}{NUMBERS}]")
        latin = latin.replace("\\p{L}", f"[{LETTERS}]").replace("\\p{N}", f"[{NUMBERS}]")
        self.latin = re.compile(latin).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)


class Tokenizer:
    """Encoding and decoding of lists of byte strings in a DuckDB database of this process alone."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = np.array([
            (ranks[token[:at]] * PAIR + ranks[token[at:]], rank)
            for token, rank in ranks.items() for at in range(1, len(token)) if token[:at] in ranks and token[at:] in ranks
        ] or np.empty((0, 2)), np.int64)
        # Each byte of a token as the character of that number.
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int64()), "piece": [t.decode("latin-1") for t in ranks]})
        self.database = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        self.database.register("merge_rows", pa.table({"pair": splits[:, 0], "made": splits[:, 1]}))
        self.database.register("vocabulary_rows", vocabulary)
        self.database.execute(SETUP)

    def lists(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.database.register(name, rows)
        found = self.database.sql(sql).to_arrow_table()
        for name in tables:
            self.database.unregister(name)
        return found

    def encode_pieces(self, words: list[bytes]) -> pa.ListArray:
        """Ids of short, non-empty words."""
        joined = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        at = np.arange(len(joined)) - np.repeat(ends - sizes, sizes)
        tokens = self.single[joined]
        after = np.append(tokens[1:], np.int32(-1))
        after[ends - 1] = -1
        number = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        symbols = pa.table({"w": number, "pos": at.astype(np.int32), "a": tokens, "b": after})
        return self.lists(ENCODE, symbols=symbols).column("ids").combine_chunks()

    def decode_lists(self, lists: list[list[int]] | pa.ListArray) -> list[bytes]:
        """Bytes of non-empty lists of ids."""
        rows = pa.table({"w": np.arange(len(lists)), "ids": pa.array(lists, pa.list_(pa.int64()))})
        return [p.encode("latin-1") for p in self.lists(DECODE, lists=rows).column("piece").to_pylist()]

    def blocks(self, words: list[bytes]) -> Iterator[list[bytes]]:
        block, held = [], 0
        for word in words:
            block.append(word)
            held += len(word)
            if held >= BLOCK_BYTES:
                yield block
                block, held = [], 0
        if block:
            yield block

    def encode(self, words: list[bytes]) -> Iterator[tuple[bytes, str, bytes]]:
        """Non-empty words of any length, in any order, with their ids and what these decode to; a word that is a token is that token."""
        short = [w for w in words if w not in self.ranks and len(w) <= PIECE_BYTES]
        for block in self.blocks(short):
            yield from self.both(block, self.encode_pieces(block))
        for block in self.blocks([w for w in words if w in self.ranks]):
            yield from self.both(block, pa.array([[self.ranks[w]] for w in block], pa.list_(pa.int64())))
        for word in words:
            if len(word) > PIECE_BYTES and word not in self.ranks:
                yield from self.both([word], pa.array([self.encode_long(word)], pa.list_(pa.int64())))

    def both(self, words: list[bytes], ids: pa.ListArray) -> Iterator[tuple[bytes, str, bytes]]:
        """Words with their ids in decimal, joined by commas, and the bytes decoded from them."""
        listed = pa.ListArray.from_arrays(ids.offsets, pc.cast(ids.values, pa.string()))
        return zip(words, pc.binary_join(listed, ",").to_pylist(), self.decode_lists(ids))

    def encode_long(self, word: bytes) -> list[int]:
        cut = [word[at: at + PIECE_BYTES] for at in range(0, len(word), PIECE_BYTES)]
        parts = [ids for block in self.blocks(cut) for ids in self.encode_pieces(block).to_pylist()]
        while len(parts) > 1:
            pairs = list(zip(parts[::2], parts[1::2]))
            parts = self.joined(pairs) + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0]

    def joined(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """Encodings of neighbours as one, by encoding what lies around each seam again."""
        made: list[list[int] | None] = [None] * len(pairs)
        reach, todo = SEAM_TOKENS, list(range(len(pairs)))
        while todo:
            seams = [pairs[n][0][-reach:] + pairs[n][1][:reach] for n in todo]
            texts = [t for block in self.blocks(seams) for t in self.decode_lists(block)]
            rest = []
            for n, ids in zip(todo, (ids for block in self.blocks(texts) for ids in self.encode_pieces(block).to_pylist())):
                left, right = pairs[n]
                fits_left = len(left) <= reach or ids[0] == left[-reach]
                fits_right = len(right) <= reach or ids[-1] == right[reach - 1]
                if fits_left and fits_right:
                    made[n] = left[:-reach] + ids + right[reach:]
                else:
                    rest.append(n)
            todo, reach = rest, reach * 2
        return made


class KeptWords:
    """Words as text with their ids and the bytes decoded from these, of this generation of words and of the last."""

    def __init__(self) -> None:
        self.recent: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def meet(self, words: set[str], tokenizer: Tokenizer) -> dict[str, tuple[str, bytes]]:
        """A mapping that holds all of ``words``."""
        if len(self.recent) > KEPT_WORDS // 2:
            self.recent, self.older = {}, self.recent
        missing = words.difference(self.recent)
        new = []
        for word in missing:
            found = self.older.get(word)
            if found is None:
                new.append(word.encode())
            else:
                self.recent[word] = found
        self.recent.update((word.decode(), (ids, decoded)) for word, ids, decoded in tokenizer.encode(new))
        return self.recent


_tokenizers: dict[tuple[str, str], tuple[Tokenizer, WordSplitter, KeptWords]] = {}


def opened(path: str, pattern: str) -> tuple[Tokenizer, WordSplitter, KeptWords]:
    """The tokenizer of this worker process and the words it has met."""
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(read_ranks(path)), WordSplitter(pattern), KeptWords()
    return _tokenizers[path, pattern]


def encoded_and_decoded(texts: list[str | None], path: str, pattern: str) -> tuple[list[str], list[bytes]]:
    """Ids of each text, in decimal and joined by commas, and the bytes they decode to; null counts as empty."""
    tokenizer, split, kept = opened(path, pattern)
    lists = [split(t or "") for t in texts]
    known = kept.meet(set().union(*lists), tokenizer)
    ids, decoded = [], []
    for words in lists:
        numbers, parts = zip(*map(known.__getitem__, words)) if words else ((), ())
        ids.append(",".join(numbers))
        decoded.append(b"".join(parts))
    return ids, decoded


def encoded_ids(texts: list[str | None], path: str, pattern: str) -> list[str]:
    """Ids of each text, in decimal and joined by commas; null counts as empty."""
    return encoded_and_decoded(texts, path, pattern)[0]


def decoded_texts(ids: list[str], path: str, pattern: str) -> list[bytes]:
    """Bytes of each list of ids in decimal, joined by commas."""
    tokenizer, _, _ = opened(path, pattern)
    lists = [np.fromstring(text, np.int64, sep=",") for text in ids]
    texts = iter(tokenizer.decode_lists([one for one in lists if len(one)]) if any(map(len, lists)) else [])
    return [next(texts) if len(one) else b"" for one in lists]


Finish = Callable[[list[str], list[bytes]], list[pa.Array]]


def digests(ids: list[str], decoded: list[bytes]) -> list[pa.Array]:
    return [pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]


def values(ids: list[str], decoded: list[bytes]) -> list[pa.Array]:
    return [pa.array([np.fromstring(i, np.int32, sep=",") for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, names: list[str], finish: Finish) -> Iterator[pa.RecordBatch]:
    """Rows with the number of ids and two results in place of the text, which comes last, a block of texts at a time."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for start, end in pieces(texts, TEXT_BLOCK):
            ids, decoded = encoded_and_decoded(texts[start:end], path, pattern)
            carried = batch.slice(start, end - start).columns[:-1]
            counts = pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*carried, counts, *finish(ids, decoded)], names)


def encoded(docs: DataFrame, path: str, pattern: str, text: str, finish: Finish, new: dict[str, str]) -> DataFrame:
    carried = [c for c in docs.columns if c != text and c not in new]
    body = "_text" + "_" * max(map(len, carried), default=0)
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text).cast("string").alias(body))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    names = [*carried, *new]
    return arrow_map(rows, lambda b: encode_batches(b, path, pattern, names, finish), ", ".join([*fields, *(f"{n} {t}" for n, t in new.items())]))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every row with ``n_tokens, ids, decoded`` in place of ``text``: the ids, and the bytes decoded from them again.

    Null counts as empty, which has no ids; repeated rows are encoded each; columns of the input with the names of
    the new ones are replaced; an empty table gives no rows.
    """
    return encoded(docs, path, pattern, text, values, {"n_tokens": "long", "ids": "array<int>", "decoded": "binary"})


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As ``encode_documents``, with digests of the decimal ids joined by commas and of the decoded bytes instead of both."""
    return encoded(docs, path, pattern, text, digests, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
