"""Spectra that grow row by row: symmetric rank-one updates through the secular equation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPSILON = np.finfo(np.float64).eps
MOST_STEPS = 80


def _deflate(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Which entries take part, after rotating those with nearly equal values into one of them; works in place.

    ``values`` ascend. What is left out stays an eigenpair to working precision.
    """
    tolerance = 8 * EPSILON * max(np.abs(values).max(initial=0.0), rho)
    active = rho * np.abs(z) > tolerance
    last = -1
    for at in np.flatnonzero(active):
        if last >= 0:
            gap, length = values[at] - values[last], np.hypot(z[at], z[last])
            cosine, sine = z[at] / length, z[last] / length
            if gap * abs(cosine * sine) <= tolerance:
                z[at], z[last] = length, 0.0
                low, high = vectors[:, last].copy(), vectors[:, at].copy()
                vectors[:, at], vectors[:, last] = cosine * high + sine * low, cosine * low - sine * high
                mixed = values[last] * sine * sine + values[at] * cosine * cosine
                values[last], values[at] = values[last] * cosine * cosine + values[at] * sine * sine, mixed
                active[last] = False
        last = at
    return np.flatnonzero(active)


def _secular(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(weights / (poles - root)) = 0``, one above each pole, and ``poles - root`` to high relative accuracy.

    A root is an offset from its nearer pole. The sums left and right of it are replaced by simple poles that agree in value
    and slope, whose root is the next guess; a guess outside the bracket is replaced by its middle.
    """
    size = len(poles)
    upper = np.append(poles[1:], poles[-1] + rho * weights.sum())
    middle = (poles + upper) / 2
    scaled = rho * weights
    with np.errstate(divide="ignore", invalid="ignore"):
        at_middle = 1 + (scaled[:, None] / (poles[:, None] - middle[None, :])).sum(0)
    near_upper = at_middle < 0
    near_upper[-1] = False
    origin = np.where(near_upper, upper, poles)
    gaps = poles[:, None] - origin[None, :]
    low = np.where(near_upper, middle - upper, 0.0)
    high = np.where(near_upper, 0.0, np.where(at_middle < 0, upper - poles, middle - poles))
    low = np.where(~near_upper & (at_middle < 0), middle - poles, low)
    offset = (low + high) / 2
    left = np.tri(size, dtype=bool).T  # poles up to and with the own one
    own, following = np.arange(size), np.minimum(np.arange(size) + 1, size - 1)
    for _ in range(MOST_STEPS):
        distance = gaps - offset[None, :]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            terms = scaled[:, None] / distance
            slopes = terms / distance
            below, above = np.where(left, terms, 0.0).sum(0), np.where(left, 0.0, terms).sum(0)
            total = 1 + below + above
            done = np.abs(total) <= 4 * EPSILON * size * (1 + np.abs(below) + np.abs(above))
            low, high = np.where(total < 0, offset, low), np.where(total >= 0, offset, high)
            done |= (high - low) <= 2 * EPSILON * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            here, beyond = distance[own, own], distance[following, own]
            slope_below, slope_above = np.where(left, slopes, 0.0).sum(0), np.where(left, 0.0, slopes).sum(0)
            weight, weight_beyond = here * here * slope_below, beyond * beyond * slope_above
            constant = 1 + (below - here * slope_below) + (above - beyond * slope_above)
            # constant + weight / (here - t) + weight_beyond / (beyond - t) = 0 for the step t.
            b = constant * (here + beyond) + weight + weight_beyond
            c = constant * here * beyond + weight * beyond + weight_beyond * here
            root = np.sqrt(np.maximum(b * b - 4 * constant * c, 0.0))
            step = np.where(b >= 0, 2 * c / (b + root), (b - root) / (2 * constant))
            step[-1] = here[-1] + weight[-1] / constant[-1] if constant[-1] > 0 else np.nan
            guess = offset + step
        inside = np.isfinite(guess) & (guess > low) & (guess < high)
        offset = np.where(done, offset, np.where(inside, guess, (low + high) / 2))
    return origin + offset, gaps - offset[None, :]


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs, values ascending, of ``vectors @ diag(values) @ vectors.T + rho * direction direction'`` for ``rho >= 0``.

    The weights are computed again from the roots, so the new vectors are orthogonal to working precision.
    """
    z = vectors.T @ direction
    length = float(np.sqrt(z @ z))
    if not rho > 0 or length == 0 or not np.isfinite(length):
        return values, vectors
    z, rho = z / length, rho * length * length
    values, vectors = values.copy(), vectors.copy()
    active = _deflate(values, vectors, z, rho)
    if len(active):
        active = active[np.argsort(values[active], kind="stable")]
        poles = values[active]
        roots, distance = _secular(poles, z[active] ** 2, rho)
        size = len(active)
        # |poles[j] - poles[i]|, j before i with root j and j after i with root j - 1.
        spread = poles[:, None] - poles[None, :]
        product = np.abs(distance[:, -1]) if size else np.empty(0)
        shifted = np.where(np.tri(size, size, -1, dtype=bool), distance, np.roll(distance, 1, axis=1))
        np.fill_diagonal(spread, 1.0)
        np.fill_diagonal(shifted, 1.0)
        weights = np.sqrt(np.abs(np.prod(shifted / spread, axis=1)) * product / rho)
        inner = (np.sign(z[active]) * weights)[:, None] / distance
        inner /= np.sqrt((inner * inner).sum(0))
        values[active] = roots
        vectors[:, active] = vectors[:, active] @ inner
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, mean and scattering of rows: ``vectors @ diag(values) @ vectors.T`` is the sum of centred outer products."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, row: np.ndarray) -> None:
        """One more row: its distance from the mean so far is a rank-one update."""
        apart = row - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        """The rows of both: a rank-one update per direction of the other one, and one for the means' distance."""
        if not other.n:
            return
        both = self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        apart = other.mean - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * (other.n / both))
        self.mean = self.mean + apart * (other.n / both)
        self.n = both
