"""Byte-level BPE and token counts against the tokenizers' own libraries."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids_of(library, text):
    return ",".join(map(str, library.encode_ordinary(text or "")))


LONG = ["a" * 5_000, "etaoin" * 700 + "xyz" * 300, " " * 2_000 + "x", "é" * 3_000, "ab" * 64 + "c" * 129, "\n" * 300]


def test_long_words_are_joined_exactly(library):
    assert bpe.encoded_ids(LONG, RANKS, public_tokenizers.PATTERN) == [ids_of(library, t) for t in LONG]


def test_words_are_encoded_and_decoded_once(library, monkeypatch):
    """Decoding runs over the ids of new words, however often they stand in texts."""
    decoded, decode = [], bpe.Tokenizer.decode_lists
    monkeypatch.setattr(bpe.Tokenizer, "decode_lists", lambda self, lists: decoded.extend(lists) or decode(self, lists))
    monkeypatch.setattr(bpe, "_tokenizers", {})
    texts = ["zebra quuxly zebra quuxly"] * 50 + [None, "", "zebra"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    rows = next(bpe.encode_batches(iter([batch]), RANKS, public_tokenizers.PATTERN, ["n_tokens", "ids", "decoded"], bpe.values)).to_pylist()
    assert [r["decoded"] for r in rows] == [(t or "").encode() for t in texts]
    assert [",".join(map(str, r["ids"])) for r in rows] == [ids_of(library, t) for t in texts]
    # "zebra" with and without a blank before it, and " quuxly".
    assert len(decoded) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_encodes_and_decodes(texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids = bpe.encoded_ids(texts, RANKS, public_tokenizers.PATTERN)
    assert ids == [ids_of(library, t) for t in texts]
    assert bpe.decoded_texts(ids, RANKS, public_tokenizers.PATTERN) == [t.encode() for t in texts]


def test_documents(hard_docs, hard_rows, library):
    rows = bpe.encode_documents(hard_docs, RANKS, public_tokenizers.PATTERN).collect()
    got = sorted((r["doc_id"] or -1, r["n_tokens"], ",".join(map(str, r["ids"])), bytes(r["decoded"])) for r in rows)
    ids = [(d or -1, ids_of(library, t), (t or "").encode()) for d, t, _ in hard_rows]
    assert got == sorted((d, i.count(",") + 1 if i else 0, i, t) for d, i, t in ids)


def test_digests(hard_docs, empty_docs, library):
    row = bpe.encode_digests(hard_docs.filter("doc_id = 12"), RANKS, public_tokenizers.PATTERN).first()
    text = hard_docs.filter("doc_id = 12").first()["text"]
    assert row["ids_sha256"] == hashlib.sha256(ids_of(library, text).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["shard"] == "shard" and "text" not in row
    assert bpe.encode_digests(empty_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_kept_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 4)
    for text in ("one two three", "three four five six", "two seven", "one two three"):
        assert bpe.encoded_ids([text], RANKS, public_tokenizers.PATTERN) == [ids_of(library, text)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="thenaig ▁\n日é", max_size=400)), max_size=8))
def test_any_text_counts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.transducer(PIECES).counts(texts).tolist() == [len(processor.encode(t)) for t in texts]


def test_long_texts_count_in_chunks(processor):
    texts = [*LONG, "the quick brown fox " * 500]
    assert token_counts.transducer(PIECES).counts(texts).tolist() == [len(processor.encode(t)) for t in texts]


def test_forgotten_states_change_nothing(processor, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 10)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    machine = token_counts.Transducer(token_counts.PieceModel(PIECES))
    for text in ("the first text of all", "another text, longer than the first", "日本 the first"):
        assert machine.counts([text]).tolist() == [len(processor.encode(text))]


def test_count_documents(hard_docs, empty_docs, hard_rows, processor):
    rows = token_counts.count_tokens(hard_docs, PIECES, limit=1_000).collect()
    want = [(d or -1, len((t or "").encode()), len(processor.encode(t or ""))) for d, t, _ in hard_rows]
    assert sorted((r[0] or -1, *r[1:]) for r in rows) == sorted((*w, w[2] > 1_000) for w in want)
    assert token_counts.count_tokens(empty_docs, PIECES).count() == 0
