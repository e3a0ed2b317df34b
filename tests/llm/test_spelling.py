from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tabloom.llm import spelling_variants as variants

SCHEMA = "doc_id long, text string, word string, n string, form string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "w", "n", "f", "k") for row in rows], SCHEMA)


def counted(rows) -> dict[str, int]:
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            hashed = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if hashed % 31 == 0:
                word = word[: hashed % len(word)] + word[hashed % len(word) + 1:]
            if len(word) >= 7:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1:] or a[at + 1:] == b[at + 1:]


def brute(rows) -> dict[str, tuple]:
    counts = counted(rows)
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    forms = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= 10 * counts[word]:
            forms[word] = best
    out = {}
    for word in counts:
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        out[word] = (counts[word], len(near[word]), form, counts.get(form), root)
    return out


def found(spark, rows) -> dict[str, tuple]:
    got = variants.variants(frame(spark, rows)).collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got}
    assert len(out) == len(got)
    return out


def mangled(pick: random.Random, word: str, letters: str) -> str:
    at, kind = pick.randrange(len(word) + 1), pick.randrange(3)
    if kind == 0:
        return word[:at] + pick.choice(letters) + word[at:]
    return word[:at] + (pick.choice(letters) if kind == 1 else "") + word[at + 1:]


@pytest.mark.parametrize("letters", ["ab", "abcdefghéÿ×"])
def test_against_brute_force(spark, letters):
    pick = random.Random(len(letters))
    base = ["".join(pick.choice(letters) for _ in range(pick.randint(6, 14))) for _ in range(25)]
    words = []
    for word in base:
        words += [word.upper()] * 300
        for _ in range(8):
            near = mangled(pick, word, letters)
            words += [near] * pick.choice((2, 25, 29))
            words += [mangled(pick, near, letters)] * 2
    pick.shuffle(words)
    rows = [(i if i % 3 else None, " ".join(words[i * 40:(i + 1) * 40])) for i in range(len(words) // 40 + 1)]
    expected = brute(rows)
    assert any(f for _, _, f, _, _ in expected.values()) and any(r != f and f for _, _, f, _, r in expected.values())
    assert found(spark, rows) == expected


def test_every_near_pair_shares_a_key():
    pick = random.Random(9)
    for _ in range(3_000):
        letters = pick.choice(("ab", "abcd", "abcdefghijklm"))
        a = "".join(pick.choice(letters) for _ in range(pick.randint(7, 12)))
        b = mangled(pick, a, letters)
        if len(b) < 7 or a == b:
            continue
        grams = sorted({w[i:i + 2] for w in (a, b) for i in range(len(w) - 1)})
        pick.shuffle(grams)
        rank = {g: i for i, g in enumerate(grams)}
        assert (variants.pivot_keys(a, rank) & variants.prefix_keys(b, rank)) | (variants.pivot_keys(b, rank) & variants.prefix_keys(a, rank))


def test_pivots_do_not_overlap_and_are_rarest():
    rank = {"ab": 5, "bc": 1, "cd": 2, "de": 9, "ef": 3, "fg": 8}
    places = variants.prefix("abcdefg", rank)
    assert places == [1, 2, 4] and variants.pivots("abcdefg", places, rank) == (1, 4)


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "Wonderful wonderful"), (None, "Wonderful wonderful"), (3, "Écoleécole \U0001f600 " * 3)]
    rows.append((4, "incredible " * 60_000 + "incredibel incredibel incredibe incredibe"))
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}


def test_given_documents(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    assert found(spark, rows) == brute(rows)
