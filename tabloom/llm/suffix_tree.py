"""A probabilistic suffix tree over bytes, and the automaton that finds the longest suffix state of every position.

A kept context's distribution is that of its counts, each less a discount, and what the discounts free goes to the distribution of
the context one byte shorter: a context seen once leaves most to its parent, one seen often with few different bytes next to
nothing. The root does the same with the uniform distribution, so every byte has a probability after every context.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
DISCOUNT = 0.8
SYMBOLS = 256


def distributions(length: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[dict, list[np.ndarray]]:
    """Contexts ``(length, packed bytes) -> row`` and their rows of byte probabilities.

    ``total`` is the count of the whole context. Contexts of a length follow those one shorter; one whose
    parent is not there is left out.
    """
    root = np.full(SYMBOLS, 1 / SYMBOLS)
    zero = length == 0
    if zero.any():
        root = _smoothed(symbol[zero], count[zero], count[zero].sum(), root)
    found, rows = {(0, 0): 0}, [root]
    order = np.lexsort((symbol, context, length))
    length, context, symbol, count, total = (x[order] for x in (length, context, symbol, count, total))
    bounds = np.flatnonzero(np.concatenate(([True], (length[1:] != length[:-1]) | (context[1:] != context[:-1]), [True]))) if len(length) else np.array([0])
    for start, end in zip(bounds[:-1], bounds[1:]):
        size, packed = int(length[start]), int(context[start])
        parent = found.get((size - 1, packed & ((1 << 8 * (size - 1)) - 1))) if size else None
        if parent is not None:
            found[size, packed] = len(rows)
            rows.append(_smoothed(symbol[start:end], count[start:end], total[start], rows[parent]))
    return found, rows


def _smoothed(symbol: np.ndarray, count: np.ndarray, total: float, parent: np.ndarray) -> np.ndarray:
    row = DISCOUNT * len(symbol) / total * parent
    row[symbol] += (count - DISCOUNT) / total
    return row


class SuffixAutomaton:
    """Dense tables over states and byte classes: the next state, and the log10 probability of the byte.

    States are the kept contexts and their beginnings. A beginning that is not kept itself has the distribution
    of its longest kept suffix. Bytes that occur in no kept context and have no count share the last class.
    """

    def __init__(self, kept: dict[tuple[int, int], int], rows: list[np.ndarray]) -> None:
        strings = {packed.to_bytes(size, "big"): row for (size, packed), row in kept.items()}
        nodes = sorted({s[:k] for s in strings for k in range(len(s) + 1)}, key=lambda s: (len(s), s))
        number = {s: n for n, s in enumerate(nodes)}
        seen = rows[0] > rows[0].min()
        for string in nodes:
            seen[list(string)] = True
        self.classes = np.full(SYMBOLS, int(seen.sum()), np.uint8 if seen.sum() < SYMBOLS else np.int16)
        self.classes[seen] = np.arange(seen.sum())
        width = int(seen.sum()) + 1
        symbols = np.append(np.flatnonzero(seen), np.flatnonzero(~seen)[:1] if not seen.all() else 0)
        self.following = np.zeros((len(nodes), width), np.int32)
        self.scores = np.empty((len(nodes), width), np.float32)
        self.depths = np.zeros(len(nodes), np.int8)
        fail, row_of = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        children: list[list[tuple[int, int]]] = [[] for _ in nodes]
        for string, n in number.items():
            if string:
                children[number[string[:-1]]].append((int(self.classes[string[-1]]), n))
        for n, string in enumerate(nodes):
            row_of[n] = strings[string] if string in strings else row_of[fail[n]]
            self.depths[n] = len(string) if string in strings else self.depths[fail[n]]
            if n:
                self.following[n] = self.following[fail[n]]
            for kind, child in children[n]:
                fail[child] = self.following[fail[n], kind] if n else 0
            for kind, child in children[n]:
                self.following[n, kind] = child
            self.scores[n] = np.log10(rows[row_of[n]][symbols])

    def after(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How long the context is that is found before the last byte of packed sequences, and the log probability of that byte."""
        states = np.zeros(len(packed), np.int64)
        for k in range(DEPTH, 0, -1):
            states = self.following[states, self.classes[packed >> 8 * k & 255]]
        return self.depths[states], self.scores[states, self.classes[packed & 255]]

    def score(self, stream: np.ndarray, begin: np.ndarray, size: np.ndarray, depths: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of stretches of a byte stream; each is preceded by ``DEPTH`` bytes that set its state.

        ``depths``, as long as the stream, is told how long the context is that was found before each of their bytes.
        """
        kinds = self.classes[stream]
        order = np.argsort(-size, kind="stable")
        at, left = begin[order], -size[order]
        states, sums = np.zeros(len(order), np.int64), np.zeros(len(order))
        width = self.following.shape[1]
        following, scores = self.following.ravel(), self.scores.ravel()
        for step in range(-DEPTH, int(size.max(initial=0))):
            k = int(np.searchsorted(left, -step)) if step >= 0 else len(order)
            cell = states[:k] * width + kinds[at[:k] + step]
            if step >= 0:
                sums[:k] += scores[cell]
                if depths is not None:
                    depths[at[:k] + step] = self.depths[states[:k]]
            states[:k] = following[cell]
        back = np.empty(len(order))
        back[order] = sums
        return back
