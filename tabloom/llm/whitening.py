"""Embedding whitening: spectra grown row by row per partition, merged in a tree, refined over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_map, column
from tabloom.llm.spectra import Spectrum
from tabloom.session import materialize

COMPONENTS = 4
SCALE = 256
# Spectra that one task merges; each is a matrix of doubles.
FAN_IN = 32
# Rows are small but each is an update of a whole spectrum: a table of few files is dealt out until tasks have this many.
TASK_ROWS = 4_096
TASKS_PER_CORE = 4
# A component with less than this share of the total variance is rounding, not a direction.
LEAST_SHARE = 1e-13
STATE = "n long, mean array<double>, spread array<double>, vectors array<double>, total array<string>"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double"
LONG_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct rows with exact ``totals`` per dimension; unit ``vectors`` in columns by falling ``values``."""

    n: int
    totals: tuple[int, ...]
    values: tuple[float, ...]
    vectors: np.ndarray
    trace: float


def scaled(vectors: DataFrame, vector: Column, scale: int = SCALE) -> DataFrame:
    """Adds ``x``, entries as ``floor(scale * entry)``; rows without a vector or with null or non-finite entries go.

    The most entries that a row holds are the dimension; a row with fewer lacks entries and goes too.
    """
    entries = vector.cast("array<double>")
    finite = ~F.exists(entries, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.filter(vector.isNotNull() & finite & (F.size(vector) > 0))
    longest = kept.agg(F.max(F.size(vector)).alias("size")).first()["size"]
    kept = kept.filter(F.size(vector) == (longest or 0))
    return kept.withColumn("x", F.transform(entries, lambda e: F.floor(e * scale).cast("long")))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(name))
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(values), -1)


def _total(rows: np.ndarray) -> list[int]:
    """Exact sums, whatever the size of the entries."""
    if len(rows) and max(abs(int(rows.max())), abs(int(rows.min()))) * len(rows) > LONG_MAX:
        return [int(v) for v in rows.astype(object).sum(0)]
    return [int(v) for v in rows.sum(0)]


def _state(spectrum: Spectrum, total: list[int]) -> pa.RecordBatch:
    lists = (spectrum.mean, spectrum.values, spectrum.vectors.ravel(), [str(v) for v in total])
    types = [pa.float64(), pa.float64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array([spectrum.n], pa.int64()), *(pa.array([list(v)], pa.list_(t)) for v, t in zip(lists, types))],
        names=["n", "mean", "spread", "vectors", "total"],
    )


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spectrum of the rows of a task, one centred update per row."""
    spectrum, total = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _matrix(batch)
        if spectrum is None:
            spectrum, total = Spectrum.empty(rows.shape[1]), [0] * rows.shape[1]
        total = [a + b for a, b in zip(total, _total(rows))]
        for row in rows.astype(np.float64):
            spectrum.add(row)
    if spectrum is not None:
        yield _state(spectrum, total)


def _spectra(batch: pa.RecordBatch) -> Iterator[tuple[Spectrum, list[int]]]:
    for n, mean, spread, vectors, total in zip(*(column(batch, c) for c in ("n", "mean", "spread", "vectors", "total"))):
        size = len(mean)
        yield Spectrum(n, np.array(mean), np.array(spread), np.array(vectors).reshape(size, size)), [int(v) for v in total]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spectrum, total = None, []
    for batch in batches:
        for other, sums in _spectra(batch):
            if spectrum is None:
                spectrum, total = other, sums
            else:
                spectrum.merge(other)
                total = [a + b for a, b in zip(total, sums)]
    if spectrum is not None:
        yield _state(spectrum, total)


def _centred(rows: np.ndarray, n: int, totals: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` exactly, as long where it fits and as Python integers otherwise, and ``x - S / n``."""
    largest = max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0
    if n * largest + max((abs(t) for t in totals), default=0) <= LONG_MAX:
        exact = rows * n - np.array(totals, np.int64)
        return exact, exact / n
    exact = rows.astype(object) * n - np.array(totals, object)
    return exact, (exact / n).astype(np.float64)


def _deviation(exact: np.ndarray) -> list[int | None]:
    """Sums of squares per row; None where a long cannot hold one."""
    if exact.dtype != object and exact.size and int(np.abs(exact).max()) ** 2 * exact.shape[1] <= LONG_MAX:
        return [int(v) for v in (exact * exact).sum(1)]
    sums = (exact.astype(object) ** 2).sum(1) if exact.size else []
    return [int(v) if v <= LONG_MAX else None for v in sums]


def _products(directions: np.ndarray, n: int, totals: tuple[int, ...]):
    """Sums of products of the rows' projections per task, as one array."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = directions.shape[1]
        held = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                projected = _centred(_matrix(batch), n, totals)[1] @ directions
                held += projected.T @ projected
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["products"])

    return step


def _covariance(rows: DataFrame, directions: np.ndarray, n: int, totals: tuple[int, ...]) -> np.ndarray:
    """Covariance of the projections over all rows; as many sums as entries come to the driver."""
    parts = arrow_map(rows, _products(directions, n, totals), "products array<double>")
    sums = parts.select(F.posexplode("products").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    size, out = directions.shape[1], np.zeros(directions.shape[1] ** 2)
    for row in sums:
        out[row["at"]] = row["value"]
    return out.reshape(size, size) / n


def fit(rows: DataFrame) -> Whitening | None:
    """The eigenpairs of the covariance of stored distinct rows ``x``; None without rows.

    A task grows the spectrum of its rows, then spectra are merged ``FAN_IN`` at a time until one is left. Its vectors are an
    orthonormal basis close to the eigenvectors. The covariance of all rows in that basis is summed once more and its small
    eigenproblem solved, so that the result does not depend on how rows were dealt beyond rounding. What comes to the driver
    is one spectrum and one matrix, both of the square of the dimension.
    """
    wanted = min(-(-rows.count() // TASK_ROWS), TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.select("x").repartition(wanted) if wanted > 1 else rows.select("x")
    states = materialize(arrow_map(dealt, _grow, STATE), "spectra")
    left = states.count()
    if not left:
        return None
    while left > 1:
        tasks = -(-left // FAN_IN)
        states = materialize(arrow_map(states.repartition(tasks), _merge, STATE), "spectra")
        left = states.count()
    state = states.first()
    n, totals, size = state["n"], tuple(int(v) for v in state["total"]), len(state["mean"])
    basis = np.array(state["vectors"]).reshape(size, size)
    inner = _covariance(rows, basis, n, totals)
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values, kind="stable")
    vectors = (basis @ turned)[:, order]
    # One sign per vector: its largest entry is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(size)])
    return Whitening(n, totals, tuple(float(v) for v in np.maximum(values[order], 0.0)), vectors, float(np.trace(inner)))


def _whitener(model: Whitening, components: int):
    share = [v / model.trace if model.trace > 0 else 0.0 for v in model.values[:components]]
    with np.errstate(divide="ignore"):
        scale = np.array([1 / np.sqrt(v) if s > LEAST_SHARE else np.nan for v, s in zip(model.values, share)])
    directions = model.vectors[:, :components] * scale

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, centred = _centred(_matrix(batch), model.n, model.totals)
            white, count, width = centred @ directions, batch.num_rows, len(share)
            ids = batch.column(batch.schema.get_field_index("_id")).take(pa.array(np.repeat(np.arange(count), width)))
            deviation = _deviation(exact)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * width, model.n, np.int64)),
                    pa.array([v for v in deviation for _ in range(width)], pa.int64()),
                    pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())),
                    pa.array(share * count, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return step, directions


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    The covariance is that of the distinct vectors ``x = floor(scale * entry)``, each once. ``whitened`` is ``x`` less the mean,
    projected on the component, in standard deviations; ``deviation`` is the sum over dimensions of ``(n * x - S)^2``, null beyond a
    long. ``identity_error`` is measured: the largest entry of the covariance of ``whitened`` over the distinct vectors less the identity.

    Rows whose vector is null or empty, shorter than the longest one, or holds null or non-finite entries are left out; rows with a
    null key and repeated rows stay. Entries beyond a long become the nearest long. A component without variance has null
    ``whitened`` and counts nowhere else. Of components with equal variance the order and direction are those of the eigenproblem
    solved. Other columns are not read. No rows, or none left, no rows. A task holds its batch and a few square matrices.
    """
    ready = scaled(vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vector")), F.col("_vector"), scale)
    distinct = materialize(ready.select("x").distinct(), "distinct_vectors")
    model = fit(distinct)
    if model is None:
        return ready.sparkSession.createDataFrame([], WHITENED + ", identity_error double")
    step, directions = _whitener(model, components)
    varied = directions[:, ~np.isnan(directions).any(0)]
    error = None
    if varied.shape[1]:
        error = float(np.abs(_covariance(distinct, varied, model.n, model.totals) - np.eye(varied.shape[1])).max())
    rows = arrow_map(ready.select("_id", "x"), step, WHITENED)
    return rows.withColumn("identity_error", F.lit(error).cast("double"))
