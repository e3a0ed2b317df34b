"""Rows that are hard to get right: nulls, empty and long texts, repeats, and columns named like those of the operators."""

from __future__ import annotations

import random

import pytest

UPPER = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
CLASHING = ("kept", "n_words", "ids", "id", "component", "size", "shard", "start", "_row", "_text", "_k1", "win", "n_tokens", "row", "key")


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(("th", "an", "er", "ión", "ß", "qu", "a")) for _ in range(pick.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def hard_rows():
    """``doc_id, text, lang`` of the rows."""
    base = prose(1, 200)
    near = base.replace(" ", "  ", 3) + " extra words at the end"
    return [
        (1, base, "en"), (2, base, None), (2, base, None), (3, near, "en"), (4, "", "en"), (5, None, "de"), (6, " \n\t ", "fr"),
        (7, "one two", "en"), (8, "One TWO", "en"), (9, prose(2, 12_000), "en"), (None, "no id here", "en"), (None, base, None),
        (10, "x" * 3_000, "en"), (11, 'the token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" is\nAll rights reserved. CC BY', "en"),
        (12, "日本語 " * 50 + "😀", "jp"), (13, "<|im_start|> <s> <|endoftext|> \x00 \x1c end", "en"), (14, base.encode().translate(UPPER).decode(), "en"),
    ]


@pytest.fixture
def hard_docs(spark, hard_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*row, "s", 1, *CLASHING) for row in hard_rows], schema)


@pytest.fixture
def empty_docs(hard_docs):
    return hard_docs.limit(0)
