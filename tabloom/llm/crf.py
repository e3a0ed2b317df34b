"""A linear-chain conditional random field over three tags, trained by gradient and decoded by Viterbi, in numpy.

A token is seen as the number of its shape. Scores of a tag add up from tables over the shapes of the token, of its
neighbours and of the pair with the token before, over the kind of file, and over the tag before, and from tables over
the hashed parts of the names that stand next to it: the two before and the one behind.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS = 3
FORBIDDEN = -1e4
RATE, STEPS, DECAY = 0.3, 80, 1e-4
# Before it learns anything the field takes every token to be outside by so much.
PRIOR = 4.0
# Hashed parts of names, and the places of the names that a token looks at.
BUCKETS = 4_096
NEAR = ("name", "name2", "next")


class Row(list):
    """The shapes of a row's tokens; ``names`` has, per token and place in ``NEAR``, the buckets of the name there."""

    def __init__(self, shapes: list[int], names: list[list[list[int]]]) -> None:
        super().__init__(shapes)
        self.names = names


@dataclass
class Field:
    """Tables by offset of the shape looked at, of pairs of shapes, of files, of near names, and of tag after tag."""

    shapes: int
    files: int
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.tables:
            sizes = {"here": (self.shapes,), "before": (self.shapes,), "before2": (self.shapes,), "after": (self.shapes,),
                     "pair": (self.shapes, self.shapes), "file": (self.files, self.shapes), "tag": (TAGS,),
                     **{name: (BUCKETS,) for name in NEAR}}
            self.tables = {name: np.zeros((*size, TAGS)) for name, size in sizes.items()}
            self.tables["here"][:, OUTSIDE] = PRIOR

    def views(self, shapes: np.ndarray, files: np.ndarray) -> dict[str, tuple]:
        """For rows of shapes, padded by 0 at both ends, the cells of each table that score each token."""
        here, before, after = shapes[:, 2:-1], shapes[:, 1:-2], shapes[:, 3:]
        return {"here": (here,), "before": (before,), "before2": (shapes[:, :-3],), "after": (after,), "pair": (before, here),
                "file": (np.broadcast_to(files[:, None], here.shape), here)}

    def emissions(self, shapes: np.ndarray, files: np.ndarray) -> np.ndarray:
        return sum(self.tables[name][cells] for name, cells in self.views(shapes, files).items())

    def stream_emissions(self, stream: np.ndarray, files: np.ndarray, spelled: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Scores of the tokens of many rows in one stream, each row ended by a 0; zeros are outside.

        ``files`` is the kind per token, ``near`` the number, by place and token, of the name there, and ``spelled``
        has the scores by place of every number.
        """
        ends = np.concatenate(([0, 0], stream, [0]))
        before, here, after = ends[1:-2], ends[2:-1], ends[3:]
        before2 = np.where(before == 0, 0, ends[:-3])
        tables = self.tables
        pairs = tables["pair"] + tables["here"][None] + tables["before"][:, None]
        scores = pairs[before, here]
        scores += tables["before2"][before2]
        scores += tables["after"][after]
        scores += tables["file"][files, here]
        for place in range(len(NEAR)):
            scores += spelled[place][near[place]]
        scores[here == 0] = (0.0, FORBIDDEN, FORBIDDEN)
        return scores

    def transitions(self) -> np.ndarray:
        """Scores of a tag, column, after another, row; nothing is inside without a begin."""
        scores = self.tables["tag"].copy()
        scores[OUTSIDE, INSIDE] = FORBIDDEN
        return scores


def near_cells(rows: list[list[int]], width: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each place in ``NEAR`` the flat positions, in rows of ``width`` tokens, and the buckets that score them."""
    cells = {}
    for place, name in enumerate(NEAR):
        pairs = [(n * width + at, bucket) for n, row in enumerate(rows) for at, names in enumerate(getattr(row, "names", ())) for bucket in names[place]]
        cells[name] = tuple(np.array(pairs, np.int64).reshape(-1, 2).T)
    return cells


def added(values: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """Rows of values per tag summed by number."""
    return np.stack([np.bincount(where, values[:, tag], size) for tag in range(TAGS)], axis=-1)


def padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of shapes with two zeros before and at least one behind, and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    table = np.zeros((len(rows), int(lengths.max(initial=0)) + 3), np.int64)
    for n, row in enumerate(rows):
        table[n, 2: 2 + len(row)] = row
    return table, lengths


def summed(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis=axis, keepdims=True)
    return np.log(np.exp(scores - top).sum(axis=axis)) + np.squeeze(top, axis)


def gathered(sizes: tuple[int, ...], where: tuple, values: np.ndarray) -> np.ndarray:
    """Values per tag summed by cell."""
    flat = np.ravel_multi_index(where, sizes).ravel()
    sums = [np.bincount(flat, values[:, :, tag].ravel(), int(np.prod(sizes))) for tag in range(TAGS)]
    return np.stack(sums, axis=-1).reshape(*sizes, TAGS)


def trained(rows: list[list[int]], tags: list[list[int]], files: list[int], shapes: int, kinds: int, barred: tuple[int, ...] = ()) -> Field:
    """The field of greatest conditional likelihood, by adaptive full-batch gradient steps with a small decay to the prior.

    No shape may be barred from any tag.
    """
    if barred:
        raise ValueError("every shape may have every tag")
    model = Field(shapes, kinds)
    if not rows:
        return model
    table, lengths = padded(rows)
    gold, _ = padded(tags)
    gold, files = gold[:, 2:-1], np.array(files)
    width = gold.shape[1]
    real = np.arange(width)[None, :] < lengths[:, None]
    cells, near = model.views(table, files), near_cells(rows, width)
    target = np.eye(TAGS)[gold] * real[:, :, None]
    follows = real[:, 1:]
    steps = np.zeros((TAGS, TAGS))
    np.add.at(steps, (gold[:, :-1][follows], gold[:, 1:][follows]), 1)
    power = {name: np.full_like(t, 1e-8) for name, t in model.tables.items()}
    prior = {name: t.copy() for name, t in model.tables.items()}
    for _ in range(STEPS):
        emit, trans = model.emissions(table, files), model.transitions()
        for name, (places, buckets) in near.items():
            emit = emit + added(model.tables[name][buckets], places, emit.shape[0] * width).reshape(emit.shape)
        # A first tag follows an outside one.
        forward = np.empty_like(emit)
        forward[:, 0] = emit[:, 0] + trans[OUTSIDE]
        for t in range(1, width):
            step = summed(forward[:, t - 1, :, None] + trans, 1) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
        total = summed(forward[:, -1], 1)
        backward = np.zeros_like(emit)
        pairs = np.zeros((TAGS, TAGS))
        for t in range(width - 2, -1, -1):
            ahead = emit[:, t + 1] + backward[:, t + 1]
            pair = np.exp(forward[:, t, :, None] + trans + ahead[:, None, :] - total[:, None, None])
            pairs += pair[real[:, t + 1]].sum(axis=0)
            backward[:, t] = np.where(real[:, t + 1, None], summed(trans[None] + ahead[:, None, :], 2), 0)
        chance = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        difference = target - chance
        gradient = {name: np.zeros_like(t) for name, t in model.tables.items()}
        for name, where in cells.items():
            gradient[name] += gathered(gradient[name].shape[:-1], where, difference)
        for name, (places, buckets) in near.items():
            gradient[name] += added(difference.reshape(-1, TAGS)[places], buckets, BUCKETS)
        gradient["tag"] += steps - pairs
        gradient["tag"][OUTSIDE] += difference[:, 0].sum(axis=0)
        for name, slope in gradient.items():
            slope = slope / len(rows) - DECAY * (model.tables[name] - prior[name])
            power[name] += slope**2
            model.tables[name] += RATE * slope / np.sqrt(power[name])
    return model


def open_tokens(model: Field, emit: np.ndarray) -> np.ndarray:
    """Which tokens of a stream the weights do not prove to be outside.

    Against tags that are all outside, a run of other tags gains what entering, its tokens, going on between them and
    leaving score. The gain of a run is bounded by the best of its ways; a token that no run with a bound
    above nothing covers is outside in the best tags. What tokens score comes with their real neighbours.
    """
    trans = model.transitions()
    stay = trans[OUTSIDE, OUTSIDE]
    begin, inside = emit[:, BEGIN] - emit[:, OUTSIDE], emit[:, INSIDE] - emit[:, OUTSIDE]
    on = np.maximum(begin + max(trans[BEGIN, BEGIN], trans[INSIDE, BEGIN]), inside + max(trans[BEGIN, INSIDE], trans[INSIDE, INSIDE])) - stay
    sums = np.cumsum(on)
    entered = np.maximum.accumulate(trans[OUTSIDE, BEGIN] - stay + begin - sums)
    left = np.maximum.accumulate(sums[::-1])[::-1]
    leave = max(trans[BEGIN, OUTSIDE] - stay, trans[INSIDE, OUTSIDE] - stay, 0.0)
    # Sums over a stream are rounded; a doubtful token is open.
    return entered + left + leave > -1e-3


def decoded(model: Field, rows: list[list[int]], files: list[int]) -> list[np.ndarray]:
    """The best tags of each row."""
    emits = []
    for row, file in zip(rows, files):
        table, _ = padded([row])
        emit = model.emissions(table, np.array([file]))[0]
        for name, (places, buckets) in near_cells([row], len(row)).items():
            emit = emit + added(model.tables[name][buckets], places, len(row))
        emits.append(emit)
    return best_tags(model, emits)


def best_tags(model: Field, emits: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each row of scores by Viterbi; rows run side by side, the longest first."""
    order = sorted(range(len(emits)), key=lambda n: -len(emits[n]))
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(emits)
    trans = model.transitions()
    # Rows of like length go together, so that one long row does not pad the others.
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and len(emits[order[end]]) * 2 > len(emits[order[start]]) and end - start < 4_096:
            end += 1
        chosen = order[start:end]
        lengths = np.array([len(emits[n]) for n in chosen])
        emit = np.zeros((len(chosen), int(lengths[0]), TAGS))
        for n, at in enumerate(chosen):
            emit[n, : lengths[n]] = emits[at]
        best = emit[:, 0] + trans[OUTSIDE] if emit.shape[1] else np.zeros((len(chosen), TAGS))
        came = np.zeros(emit.shape, np.int8)
        for t in range(1, emit.shape[1]):
            ways = best[:, :, None] + trans
            here = t < lengths
            came[:, t] = np.where(here[:, None], ways.argmax(axis=1), np.arange(TAGS))
            best = np.where(here[:, None], ways.max(axis=1) + emit[:, t], best)
        tag = best.argmax(axis=1)
        tags = np.zeros(emit.shape[:2], np.int64)
        for t in range(emit.shape[1] - 1, -1, -1):
            tags[:, t] = tag
            tag = came[np.arange(len(chosen)), t, tag]
        for n, at in enumerate(chosen):
            found[at] = tags[n, : lengths[n]]
        start = end
    return found

