"""Pretrained subwords against the library that published the pattern, and back to the text."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tabloom.functions.tokens import SpecialIds
from tabloom.operators import subwords
from tabloom.operators.subwords import Subwords

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = Subwords(FILE)
MARKED = Subwords(FILE, SpecialIds(begin=50256, end=50256, markers=(("<|endoftext|>", 50256), ("<|im_start|>", 50257), ("<|im_end|>", 50258))))
TEXTS = [
    "", " ", "\n\n", "a", "it's we'LL don't 's", "  two  spaces\tand\n\n lines \n", "naïve café 日本語 テキスト \U0001f600\U0001f468‍\U0001f469 ok",
    "x" * 5_000, "ab" * 3_000, " " * 999, "1234 56,78.9", "   wide　blanks\x85\x1c", "é" * 50 + "́", "<|endoftext|>", "tail ",
    "\x00﻿￿", "(!?)--...\n\t//", None,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=PLAIN.ranks(), special_tokens={})


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def hostile(count: int) -> list[str]:
    pick = random.Random(2)
    parts = ["the ", "ing", " ", "\n", "'", "s", "é", "日", "\U0001f600", "7", "!", "\t", " ", "ab", "Z"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 60))) for _ in range(count)]


def test_ids_are_those_of_the_library(spark, library):
    texts = TEXTS + hostile(300)
    got = {r["id"]: r for r in subwords.encode(rows(spark, texts), PLAIN, ["id"]).collect()}
    for at, text in enumerate(texts):
        assert got[at]["input_ids"] == library.encode_ordinary(text or ""), text
        assert got[at]["length"] == len(got[at]["input_ids"])


def test_decoding_gives_the_text(spark):
    texts = TEXTS + hostile(300)
    for table in (PLAIN, MARKED):
        back = subwords.decode(subwords.encode(rows(spark, texts), table, ["id"]), table, ["id"], skip_special=False)
        assert {r["id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_given_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    ids = subwords.encode(docs, PLAIN, ["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["input_ids"] for r in ids.collect()} == {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in subwords.decode(ids, PLAIN, ["doc_id"]).collect()} == texts


def test_markers(spark, library):
    text = "a!<|im_start|>user\nhi <|im_end|><|endoftext|>"
    ids = subwords.encode(rows(spark, [text]), MARKED, ["id"]).first()["input_ids"]
    assert ids == [*library.encode_ordinary("a!"), 50257, *library.encode_ordinary("user\nhi "), 50258, 50256]
    kept = subwords.decode(rows(spark, [""]).selectExpr("id", f"array({','.join(map(str, ids))}) AS input_ids"), MARKED, ["id"])
    assert kept.first()["text"] == "a!<|im_start|>user\nhi <|im_end|>"  # the end id is reserved


@pytest.mark.parametrize("limit", [2, 3, 10])
def test_cut(spark, library, limit):
    texts = TEXTS + hostile(40)
    whole = {r["id"]: r["input_ids"] for r in subwords.encode(rows(spark, texts), PLAIN, ["id"], max_length=limit).collect()}
    framed = {r["id"]: r for r in subwords.encode(rows(spark, texts), MARKED, ["id"], max_length=limit, add_special=True).collect()}
    for at, text in enumerate(texts):
        assert whole[at] == library.encode_ordinary(text or "")[:limit]
        if "<|" not in (text or ""):
            assert framed[at]["input_ids"] == [50256, *library.encode_ordinary(text or "")[: limit - 2], 50256]
            assert framed[at]["length"] == len(framed[at]["input_ids"]) <= limit


def test_counts(spark, library):
    texts = TEXTS + hostile(100) + ["same text again"] * 200
    expected = Counter(i for t in texts for i in library.encode_ordinary(t or ""))
    got = subwords.count_subwords(rows(spark, texts), PLAIN).collect()
    assert {r["id"]: r["n"] for r in got} == expected
    assert all(PLAIN.ranks()[bytes(r["token"])] == r["id"] for r in got)


def test_odd_ids(spark, library):
    ids = library.encode_ordinary("日")
    data = [(1, [-1, 99_999_999, *library.encode_ordinary("ok")]), (2, None), (3, []), (4, [PLAIN.ranks()["日".encode()[:1]]])]
    got = {r["id"]: r["text"] for r in subwords.decode(spark.createDataFrame(data, "id long, input_ids array<int>"), PLAIN, ["id"]).collect()}
    assert got == {1: "ok", 2: "", 3: "", 4: "�"} and ids


def test_no_rows(spark):
    empty = rows(spark, ["x"]).limit(0)
    assert subwords.encode(empty, PLAIN, ["id"]).count() == 0 and subwords.count_subwords(empty, PLAIN).count() == 0


def test_nothing_is_shuffled(spark):
    ids = subwords.encode(spark.range(5).selectExpr("id", "'some text' AS text"), PLAIN, ["id"])
    assert "Exchange" not in subwords.decode(ids, PLAIN, ["id"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_batches_are_handled_in_runs_of_rows(spark, library, size):
    """However long they are, and for slices of batches too."""
    texts = [t or "" for t in TEXTS] + hostile(40) + ["a b c d e f g h i"]
    codes = [library.encode_ordinary(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(codes, pa.list_(pa.int32()))], ["id", "_ids"])
    table = [b""] * (2 + max(PLAIN.ranks().values()))
    for token, number in PLAIN.ranks().items():
        table[number] = token
    runs = list(subwords._parts([batch.slice(1), batch.slice(0, 1)], 1, size))
    assert all(r.num_rows == 1 or len(r.column(1).flatten()) <= size for r in runs) and sum(r.num_rows for r in runs) == len(texts)
    told = {i: t for r in subwords._decoder(table, 1)(iter(runs)) for i, t in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}
    assert told == dict(enumerate(texts))
