import pytest
from pyspark.sql import functions as F

from tabloom.functions.tokens import SpecialIds
from tabloom.operators import vocabulary
from tabloom.operators.vocabulary import build_vocabulary, decode, encode, encode_with

TEXTS = [(1, "b a a, c"), (2, "a b"), (3, ""), (4, None), (5, "zz a"), (6, "  ")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def listed(frame):
    return [(r["token"], r["n"], r["id"]) for r in frame.orderBy("id").collect()]


ALL = [("a", 4, 3), ("b", 2, 4), (",", 1, 5), ("c", 1, 6), ("zz", 1, 7)]


@pytest.mark.parametrize("size, kept", [(150, 5), (5, 5), (4, 4), (3, 3), (1, 1), (None, 5)])
def test_vocabulary(texts, size, kept):
    assert listed(build_vocabulary(texts, size=size)) == ALL[:kept]


def test_markers_are_one_id_each_and_come_back(spark):
    special = SpecialIds(markers=(("<|end|>", 3), ("<|end|>x", 4)))
    marked = spark.createDataFrame([(1, "a<|end|>"), (2, "<|end|>x <|en a|>")], "id long, text string")
    known = build_vocabulary(marked, special=special)
    assert {r["token"]: r["id"] for r in known.collect()} == {"a": 5, "|": 6, "<": 7, ">": 8, "en": 9}
    ids = encode(marked, known, ["id"], special=special)
    assert {r["id"]: r["input_ids"] for r in ids.collect()} == {1: [5, 3], 2: [4, 7, 6, 9, 5, 6, 8]}
    assert {r["id"]: r["text"] for r in decode(ids, known, ["id"], special=special).collect()} == {1: "a <|end|>", 2: "<|end|>x < | en a | >"}


@pytest.mark.parametrize("broadcast, frequent", [(True, 9), (None, 9), (False, 0), (False, 2), (False, 9)])
@pytest.mark.parametrize("add_special", [True, False])
def test_encode_and_decode(texts, broadcast, frequent, add_special, monkeypatch):
    monkeypatch.setattr(vocabulary, "FREQUENT_ENTRIES", frequent)
    known = build_vocabulary(texts, size=4)
    made = encode(texts, known, ["id"], max_length=5, add_special=add_special, broadcast=broadcast)
    plain = {1: [4, 3, 3, 5, 6], 2: [3, 4], 3: [], 4: [], 5: [0, 3], 6: []}
    if add_special:
        plain = {k: [1] + v[:3] + [2] for k, v in plain.items()}
    rows = {r["id"]: r for r in made.collect()}
    assert {k: r["input_ids"] for k, r in rows.items()} == plain
    assert all(r["length"] == len(r["input_ids"]) for r in rows.values())
    back = {r["id"]: r["text"] for r in decode(made, known, ["id"], broadcast=broadcast).collect()}
    assert back[1] == ("b a a" if add_special else "b a a , c")
    assert back[2] == "a b" and back[3] == "" and back[5] == "<unk> a"


def test_whole_texts_are_encoded_without_a_limit(spark):
    long = spark.createDataFrame([(1, "w " * 3000)], "id long, text string")
    made = encode(long, build_vocabulary(long), ["id"], max_length=None)
    assert made.first()["input_ids"] == [3] * 3000


def test_neither_part_fits_a_broadcast(texts, monkeypatch):
    known = build_vocabulary(texts, size=4)
    whole = encode(texts, known, ["id"]).collect()
    monkeypatch.setattr(vocabulary, "fits_broadcast", lambda *a, **k: False)
    assert sorted(map(str, encode(texts, known, ["id"]).collect())) == sorted(map(str, whole))


def test_size_check(spark):
    small = spark.createDataFrame([("a", 1)], "token string, id int")
    assert vocabulary.fits_broadcast(small) and not vocabulary.fits_broadcast(small, limit=10)
    assert vocabulary.fits_broadcast(small.limit(0))


def test_user_tokenizer(texts):
    class Letters:
        def encode_batch(self, texts):
            return [[ord(c) for c in t] for t in texts]

    made = texts.select("id", encode_with(Letters, F.col("text"), 2).alias("ids"))
    assert {r["id"]: r["ids"] for r in made.collect()} == {1: [98, 32], 2: [97, 32], 3: [], 4: [], 5: [122, 122], 6: [32, 32]}


def test_ids_start_after_the_special_ones(texts):
    assert build_vocabulary(texts, size=1, special=SpecialIds(pad=9)).first()["id"] == 10


def test_spaced_tokens_give_back_the_text(spark):
    texts = ["", " ", "a  b\n\n\tc ", "x y 　z", "(a, b) -- c!\r\n", "\n", "word", "<|im_end|>  <|im_end|>a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    special = SpecialIds(markers=(("<|im_end|>", 3),))
    known = vocabulary.build_vocabulary(rows, spaced=True, special=special).cache()
    for broadcast in (True, False):
        ids = vocabulary.encode(rows, known, ["id"], spaced=True, special=special, broadcast=broadcast)
        back = vocabulary.decode(ids, known, ["id"], spaced=True, special=special, broadcast=broadcast)
        assert {r["id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
        assert {r["id"]: r["length"] for r in ids.collect()}[7] == 4
    known.unpersist()


@pytest.mark.parametrize("spaced", [False, True])
def test_lists_are_regrouped_in_tasks_of_few_tokens(texts, spaced, monkeypatch):
    """Frequent tokens travel with their text alone, and the tasks follow from the counts, not from the bytes."""
    monkeypatch.setattr(vocabulary, "FREQUENT_ENTRIES", 1)
    monkeypatch.setattr(vocabulary, "TASK_TOKENS", 3)
    known = build_vocabulary(texts, spaced=spaced).cache()
    assert known.agg(F.sum("n")).first()[0] == (10 if spaced else 9)
    ids = encode(texts, known, ["id"], broadcast=False, spaced=spaced).cache()
    assert ids.rdd.getNumPartitions() == (4 if spaced else 3)
    back = decode(ids, known, ["id"], broadcast=False, spaced=spaced)
    assert back.rdd.getNumPartitions() == (4 if spaced else 3)
    whole = decode(encode(texts, known, ["id"], broadcast=True, spaced=spaced), known, ["id"], broadcast=True, spaced=spaced)
    assert sorted(back.collect()) == sorted(whole.collect())
    known.unpersist(), ids.unpersist()
