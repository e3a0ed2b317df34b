from __future__ import annotations

import numpy as np
import pytest

from tabloom.llm import whitening
from tabloom.llm.spectra import Spectrum, rank_one

SCHEMA = "vec_id long, embedding array<float>, n string, x string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def expected(rows):
    """Whitened rows by a dense eigenproblem, and the eigenvalues."""
    usable = [(i, v) for i, v in rows if v and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(256 * np.array([np.float32(v) for _, v in usable], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    deviation = ((n * x - total).astype(object) ** 2).sum(1)
    return [i for i, _ in usable], (x - total / n) @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviation, n


@pytest.mark.parametrize("shape", ["plain", "scales", "copies", "flat"])
def test_updates_equal_the_dense_eigenproblem(shape):
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(120, 12)) * 20
    if shape == "scales":
        rows = rows * 10.0 ** np.arange(-6, 6)
    if shape == "copies":
        rows = np.repeat(rows[:5], 9, axis=0)
    if shape == "flat":
        rows[:, 3:] = 0
    whole, left, right = Spectrum.empty(12), Spectrum.empty(12), Spectrum.empty(12)
    for at, row in enumerate(rows):
        whole.add(row)
        (left if at % 3 else right).add(row)
    left.merge(right)
    centred = rows - rows.mean(0)
    scatter = centred.T @ centred
    for spectrum in (whole, left):
        assert spectrum.n == len(rows)
        assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(12)).max() < 1e-13
        again = spectrum.vectors @ np.diag(spectrum.values) @ spectrum.vectors.T
        assert np.abs(again - scatter).max() < 1e-12 * np.abs(scatter).max()


def test_nothing_changes_without_a_direction():
    values, vectors = np.array([1.0, 2.0]), np.eye(2)
    assert rank_one(values, vectors, np.zeros(2), 1.0)[0].tolist() == [1.0, 2.0]
    assert rank_one(values, vectors, np.ones(2), 0.0)[0].tolist() == [1.0, 2.0]


def test_whitened_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_ROWS", 20)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    draw = np.random.default_rng(5)
    rows = [(i, [float(v) for v in draw.normal(size=6) * (1 + np.arange(6))]) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(80)]  # a third are copies
    rows += [(None, rows[3][1]), (300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6)]
    got = whitening.whiten(frame(spark, rows)).collect()
    ids, white, share, deviation, n = expected(rows)
    by_row = {}
    for row in got:
        by_row.setdefault(row["vec_id"], {})[row["component"]] = row
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    assert set(by_row) == set(ids) and len(got) == 4 * len(ids)
    signs = [np.sign(by_row[0][c]["whitened"] * white[0][c - 1]) for c in range(1, 5)]
    for at, key in enumerate(ids):
        for c in range(1, 5):
            row = by_row[key][c]
            assert row["whitened"] == pytest.approx(signs[c - 1] * white[at][c - 1], abs=1e-9)
            assert row["explained"] == pytest.approx(share[c - 1], rel=1e-10) and row["deviation"] == deviation[at]


def test_rows_of_a_shorter_vector_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 0.5]), (3, [0.0]), (4, [3.0, 3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted({r["vec_id"] for r in got}) == [1, 2, 4] and {r["component"] for r in got} == {1, 2}


def test_one_row_has_no_direction(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, 0.0, None)] * 4


def test_huge_entries_do_not_overflow(spark):
    got = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.5, 5.0])])).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] != 3} == {None}
    first = [r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == 1]
    assert first[0] * first[1] < 0


def test_empty(spark):
    got = whitening.whiten(frame(spark, []))
    assert got.count() == 0 and "identity_error" in got.columns
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
