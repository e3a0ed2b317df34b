"""Licence scan with a positional index of rare words.

The index holds, for every template, its words of highest inverse document frequency with their positions. A
file's words are looked up in it; each hit votes for the place where the template would start in the file.
A place is verified by the template's key phrases, all of which must stand near it word for word, and by the
share of the template's weight found around it. Fixed phrases, the base, are found besides and always kept.

Frequencies are counted over all files. What is collected are the counts of the templates' own words, so its
size is that of the templates.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import WORD_BYTES, arrow_map, column

# The phrases of the base with their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Template:
    """A licence text, its label, and the phrases that must all be there."""

    label: str
    text: str
    phrases: tuple[str, ...]


# The public notices and headers of common licences.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Licensed under the MIT License.", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License.",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template(
        "gpl-3.0", "This work is licensed under the GNU General Public License, version 3.",
        ("gnu general public license version 3",),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
        ("gnu general public license", "free software foundation"),
    ),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template(
        "cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "unlicense", "This is free and unencumbered software released into the public domain.",
        ("unencumbered software released into the public domain",),
    ),
)
RARE_WORDS = 4
SLACK = 8
LEAST_SCORE = 0.6
COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double"
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters above ASCII, A-Z in lower case."""
    return (text or "").encode().translate(WORD_BYTES).split()


def word_counts(batches: Iterator[pa.RecordBatch], words: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a partition each of ``words`` occurs."""
    found, files = Counter(), 0
    for batch in batches:
        for text in column(batch, "text"):
            found.update(words.intersection(words_of(text)))
            files += 1
    names = [w.decode() for w in found] + [None]
    yield pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "files": pa.array([*found.values(), files], pa.int64())})


def template_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[bytes, float]:
    """The inverse document frequency of every word of the templates over all texts."""
    words = frozenset(w for t in templates for w in words_of(t.text))
    counts = arrow_map(docs.select("text"), lambda b: word_counts(b, words), "word string, files long")
    rows = counts.groupBy("word").agg(F.sum("files").alias("files")).collect()
    seen = {r["word"]: r["files"] for r in rows}
    total = seen.pop(None, 0)
    return {w: math.log((total + 1) / (seen.get(w.decode(), 0) + 1)) + 1e-6 for w in words}


class RareWordIndex:
    """Postings ``word -> (template, position)`` of each template's rarest words."""

    def __init__(self, templates: tuple[Template, ...], weight: dict[bytes, float], rare: int = RARE_WORDS) -> None:
        self.templates, self.weight = templates, weight
        self.words = [words_of(t.text) for t in templates]
        self.phrases = [[words_of(p) for p in t.phrases] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, words in enumerate(self.words):
            chosen = sorted(set(words), key=lambda w: (-weight[w], w))[:rare]
            for at, word in enumerate(words):
                if word in chosen:
                    self.postings[word].append((number, at))
        self.probes = frozenset(self.postings)

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """``(label, first word, score)`` of every verified place."""
        if self.probes.isdisjoint(words):
            return []
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for at, word in enumerate(words):
            if word in self.probes:
                for number, offset in self.postings[word]:
                    votes[number, at - offset] += self.weight[word]
        found, done = [], set()
        for (number, start), _ in sorted(votes.items(), key=lambda v: (v[0][0], -v[1], v[0][1])):
            place = (number, start // SLACK)
            if place in done:
                continue
            score = self.verified(number, start, words)
            if score >= LEAST_SCORE:
                done.add(place)
                found.append((self.templates[number].label, max(0, start), score))
        return found

    def verified(self, number: int, start: int, words: list[bytes]) -> float:
        """The share of a template's weight around a place; 0 where a key phrase is missing."""
        template = self.words[number]
        around = words[max(0, start - SLACK): max(0, start + len(template) + SLACK)]
        if not all(places(around, phrase) for phrase in self.phrases[number]):
            return 0.0
        there = Counter(around) & Counter(template)
        weights = self.weight
        return sum(weights[w] * n for w, n in there.items()) / sum(weights[w] for w in template)


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand consecutively."""
    first, size = phrase[0], len(phrase)
    return [at for at, word in enumerate(words) if word == first and words[at: at + size] == phrase]


def scanned(batches: Iterator[pa.RecordBatch], index: RareWordIndex, base: list[tuple[list[bytes], str]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(column(batch, "doc_id"), column(batch, "text")):
            words = words_of(text)
            found = [(at, label) for phrase, label in base if phrase[0] in words for at in places(words, phrase)]
            matches = index.matches(words)
            starts, labels = [at for at, _ in found], {label for _, label in found}
            rows.append((
                doc, len(words), len(found), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(labels)), ",".join(sorted(labels | {label for label, _, _ in matches})),
                max((min(1.0, score) for _, _, score in matches), default=0.0),
            ))
        types = (pa.int64(),) * 5 + (pa.string(),) * 2 + (pa.float64(),)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``.

    Null and empty texts have no words and no labels; null ids pass through; repeated rows are scanned
    each; an empty table gives no rows. ``score`` is that of the best verified template, 0 without one.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = RareWordIndex(templates, template_frequencies(narrow, templates))
    base = [(words_of(phrase), label) for phrase, label in BASE_PHRASES]
    return arrow_map(narrow, lambda b: scanned(b, index, base), COLUMNS)
