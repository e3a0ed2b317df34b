"""Near duplicates, decontamination, quality rules and sharding against brute force over hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.llm import components, decontamination, near_duplicates, quality_rules, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w.decode() for w in (text or "").translate(LOWER).encode().split()]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text):
    words = words_of(text)
    return frozenset(tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    """Component per id by comparing all pairs of sets."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: (len(sets[d]), find(d)) for d in ids}


def copies(count, seed=5):
    """A text, copies with more and more words changed, and texts that share a passage."""
    pick = random.Random(seed)
    base = [f"w{pick.randint(0, 5_000)}" for _ in range(150)]
    rows = []
    for n in range(count):
        words = list(base)
        for _ in range(n % 9):
            words[pick.randrange(150)] = f"x{pick.randint(0, 10**9)}"
        rows.append((1_000 + n, " ".join(words)))
    passage = " ".join(f"p{n}" for n in range(60))
    rows += [(5_000 + n, " ".join(f"q{pick.randint(0, 10**9)}" for _ in range(50)) + " " + passage) for n in range(count)]
    return rows


def test_hard_rows_are_linked_as_by_brute_force(hard_docs, hard_rows):
    want = brute_components([(d, t) for d, t, _ in hard_rows if d is not None])
    rows = near_duplicates.report(hard_docs).collect()
    assert len(rows) == len(hard_rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None and r["component_id"]) == [(196, 1, False)]


@pytest.mark.parametrize("block", [1_024, 16])
def test_groups_of_copies_and_passages(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "LIST_BLOCK", block)
    monkeypatch.setattr(near_duplicates, "CLUSTER_BLOCK", block)
    rows = copies(60)
    got = near_duplicates.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_first_of_each_keeps_rows_whole(hard_docs, empty_docs):
    kept = near_duplicates.first_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 6, 7, 9, 10} and not {2, 8, 14} & {r["doc_id"] for r in kept.collect()}
    assert near_duplicates.report(empty_docs).count() == 0


def test_rows_without_an_id_and_texts_that_share_one(spark, monkeypatch):
    """Near copies without an id are linked, one row of a group stays, and one id does not mix up two texts."""
    pick = random.Random(8)
    base, other, alone = (" ".join(f"w{pick.randint(0, 9_999)}" for _ in range(200)) for _ in range(3))
    data = [
        (5, base), (None, base + " and more"), (None, base), (None, base), (2, other), (3, base + " tail"), (2, alone), (2, alone), (9, other + " x"),
        (None, "no id here"), (None, "no id here"), (None, ""), (None, None), (7, ""),
    ]
    names = "doc_id long, text string, _kept string, _first string, node string, k1 string, id string, component string"
    docs = spark.createDataFrame([(*row, *"abcdef") for row in data], names)
    for limit in (near_duplicates.BROADCAST_MEMBERS, 0):
        monkeypatch.setattr(near_duplicates, "BROADCAST_MEMBERS", limit)
        rows = near_duplicates.report(docs).collect()
        assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == sorted(
            [(5, 3, False), (0, 3, False), (0, 3, False), (0, 3, False), (2, 2, True), (3, 3, True), (2, 2, True), (2, 2, True), (9, 2, False),
             (0, 0, True), (0, 0, True), (0, 0, True), (0, 0, True), (7, 7, True)]
        )
        kept = near_duplicates.first_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
            [(2, other), (2, alone), (3, base + " tail"), (0, "no id here"), (0, ""), (0, ""), (7, "")]
        )


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(0, 40)] + [(100, n) for n in range(101, 140)] + [(200, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 140)}}


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Short Item"), (3, None), (4, "..."),
         (5, "the the the the the the the the the the the"), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]
TESTED = [
    (1, "xx alpha beta gamma delta epsilon zeta eta theta iota kappa yy short item"), (2, "alpha beta gamma"), (3, None), (4, ""),
    (5, "SHORT, item! short item short"), (6, "the " * 30), (7, "alpha beta gamma delta odd epsilon zeta eta theta iota kappa lambda"),
    (5, "SHORT, item! short item short"), (None, "a short item"), (8, ITEMS[0][1] + " " + ITEMS[0][1]),
]


def brute_hits(text, items=ITEMS):
    windows = {}
    for item, body in items:
        words = plain_words(body)
        for k in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[k: k + 10]), set()).add(str(item))
    words, hit, found = plain_words(text), set(), set()
    for window, names in windows.items():
        for k in range(len(words) - len(window) + 1):
            if tuple(words[k: k + len(window)]) == window:
                hit.update(range(k, k + len(window)))
                found |= names
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination(spark):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in TESTED], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontamination.report(docs, items).collect()
    assert sorted((r[0] or -1, *r[1:6]) for r in rows) == sorted((d or -1, *brute_hits(t)) for d, t in TESTED)
    assert next(r["n_near"] for r in rows if r["doc_id"] == 7) > 0
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 7]


def test_items_without_an_id_contaminate(spark):
    docs = spark.createDataFrame(TESTED, "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEMS[0][1]), (None, "odd epsilon"), (2, "Short Item")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.report(docs, items).collect()}
    digest = lambda names: hashlib.sha256(names.encode()).hexdigest()
    assert [(rows[d]["n_hit"], rows[d]["n_items"], rows[d]["items_sha256"], rows[d]["contaminated"]) for d in (1, 7, 5, 2)] == [
        (12, 2, digest("2"), True), (2, 1, digest(""), True), (4, 1, digest("2"), True), (0, 0, digest(""), False)]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [2, 3, 4, 6]


def test_a_changed_name_leaves_a_passage_near(spark):
    passage = "the river ran past Zanzibar mill before noon and turned south"
    docs = spark.createDataFrame([(1, "so " + passage.replace("Zanzibar", "Timbuktu")), (2, "mill " + "so " * 30 + "noon"), (3, passage[4:])], "doc_id long, text string")
    other = passage.replace("Zanzibar", "Qumran")
    near = {r["doc_id"]: (r["n_hit"], r["n_near"] > 0) for r in decontamination.report(docs, spark.createDataFrame([(1, other)], "item_id long, text string")).collect()}
    assert near == {1: (0, True), 2: (0, False), 3: (0, True)}
    items = spark.createDataFrame([(1, other), (None, passage)], "item_id long, text string")
    rows = {tuple(r) for r in decontamination.places(docs, items).collect()}
    assert {r for r in rows if r[3] == "exact"} == {(3, None, 0, "exact")}
    assert {(r[0], r[1]) for r in rows if r[3] == "near"} >= {(1, "1"), (3, "1")} and not any(r[0] == 2 for r in rows)
    assert (1, "1", 1, "near") in rows


def test_contamination_of_nothing(spark, hard_docs, empty_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.report(empty_docs, items).count() == 0
    none = decontamination.report(hard_docs, items.limit(0))
    assert none.count() == hard_docs.count() and none.filter("contaminated").count() == 0


def brute_figures(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    count = Counter(tuple(words[k: k + 5]) for k in range(len(words) - 4))
    repeated = {p for k in range(len(words) - 4) if count[tuple(words[k: k + 5])] > 1 for p in range(k, k + 5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def labelled(spark, docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


def test_figures(spark, hard_docs, hard_rows, empty_docs):
    extra = [(20, "a b c d e f g a b c d e x y z\n# a\n# a\n", "en"), (21, "a a a a a a a a a a a a", "en"), (22, "x y\n\n\nx y\nx y\n", None)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string")
    docs = hard_docs.select("doc_id", "text", "lang", "kept", "n_words").unionByName(more, allowMissingColumns=True)
    rows = quality_rules.report(docs, labelled(spark, docs)).collect()
    assert sorted((r[0] or -1, *r[1:7]) for r in rows) == sorted((d or -1, *brute_figures(t)) for d, t, _ in [*hard_rows, *extra])
    assert quality_rules.report(empty_docs, labelled(spark, empty_docs)).count() == 0
    kept = quality_rules.passing(hard_docs, labelled(spark, hard_docs))
    assert kept.columns == hard_docs.columns


@pytest.mark.parametrize(("k", "n", "rate"), [(0, 10, 0.01), (3, 700, 0.01), (40, 5_000, 0.01), (900, 100_000, 0.01), (0, 600, 0.01)])
def test_binomial_tail(spark, k, n, rate):
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
    want = sum(math.exp(log(i)) for i in range(k + 1))
    row = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), rate).alias("p")).first()
    assert row["p"] == pytest.approx(want, rel=1e-8)


def test_cutoffs_are_the_strictest_certified(spark):
    # 1,000 good documents in one stratum, three of them with a tenth of symbols; 20 in another stratum.
    filler, signs = " ".join(f"w{n}" for n in range(40)), " " + " ".join(f"#{n}" for n in range(20))
    rows = [(n, filler + (signs if n < 3 else ""), "en") for n in range(1_000)] + [(2_000 + n, filler, "de") for n in range(20)]
    rows += [(3_000, filler + signs, "en"), (3_001, filler + signs, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.filter("doc_id < 3000").select("doc_id", F.lit(1).alias("quality"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.report(docs, labels).collect()}
    # P(X <= 3 | 1000, 0.01) is 0.010: above 0.05 / (2 strata x 5 rules), so cutoffs that reject three are not certified.
    assert kept[3_000] and kept[3_001] and kept[0]
    stricter = {r["doc_id"]: r["kept"] for r in quality_rules.report(docs, labels.filter("doc_id >= 3")).collect()}
    assert not stricter[3_000] and stricter[3_001] and stricter[999]


def test_a_third_of_the_rows_without_a_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    docs = spark.range(0, 3_000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", "concat('t', id % 900) AS text")
    rows = sharding.shard_documents(docs, 5, slots=64).collect()
    assert len(rows) == 3_000 and sum(r["doc_id"] is None for r in rows) == 1_000
    for shard in range(5):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1


def test_sharding(spark, hard_docs, hard_rows, empty_docs):
    rows = sharding.shard_documents(hard_docs, 4, slots=64).collect()
    assert len(rows) == len(hard_rows)
    want = sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in hard_rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want
    for shard in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 4) and r["law"] == "key" for r in rows)
    alone = sharding.shard_documents(hard_docs.filter("doc_id = 9"), 4, slots=64).first()
    assert (alone["shard"], alone["grown_shard"]) == next((r["shard"], r["grown_shard"]) for r in rows if r["doc_id"] == 9)
    assert sharding.shard_documents(empty_docs, 4, slots=64).count() == 0


def test_rebalancing_moves_bytes_and_keeps_slots(spark):
    slots = [(n, n % 4, 1_000 if n % 4 == 0 else 100) for n in range(64)]
    moved = sharding.rebalanced(spark.createDataFrame(slots, "vslot long, shard int, bytes long")).collect()
    assert sorted(r["vslot"] for r in moved) == list(range(64))
    loads = Counter()
    for r in moved:
        loads[r["shard"]] += r["bytes"]
    assert max(loads.values()) <= 1.4 * sum(loads.values()) / 4


@pytest.mark.parametrize("most", (None, 0))
def test_only_claimed_texts_move(spark, monkeypatch, most):
    """Texts without a claimed window are left out by broadcast before the rest meet their claims; too many claims move all."""
    if most is not None:
        monkeypatch.setattr(decontamination, "BROADCAST_TEXTS", most)
    plans, store = {}, decontamination.materialize
    monkeypatch.setattr(
        decontamination, "materialize",
        lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or store(df, label),
    )
    words = " ".join(f"w{n}" for n in range(12))
    docs = spark.createDataFrame([(n, f"filler{n} text") for n in range(20)] + [(20, f"x {words} y"), (20, words), (21, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", words)], "item_id string, text string")
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [*range(20), 21]
    assert ("claimed-texts" in plans) == (most is None)
    assert most == 0 or "Join LeftSemi" in plans["claimed-texts"] and "strategy=broadcast" in plans["claimed-texts"]
