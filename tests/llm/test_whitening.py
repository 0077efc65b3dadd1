"""Whitening against exact integers and plain eigenvectors."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from monthmill.llm import whitening as wh


def brute(rows):
    """id -> (n, deviation, whitened up to signs, explained)."""
    xs = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in rows]
    fit = np.array(sorted({x for _, x in xs}), object)
    n, sums = len(fit), fit.sum(axis=0)
    moved = n * fit - sums
    v = np.array((moved.T.dot(moved)).tolist(), float) / float(n) ** 3
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, x in xs:
        m = n * np.array(x, object) - sums
        out[i] = n, int((m * m).sum()), (m / n).astype(float) @ vectors / np.sqrt(values), values / np.trace(v)
    return out


def compare(got, want):
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, deviation, w, explained = want[r.vec_id]
        k = r.component - 1
        sign = signs.setdefault(k, np.sign(w[k] * r.whitened))
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(sign * w[k], abs=1e-8) and r.explained == pytest.approx(explained[k], rel=1e-6)
        assert r.identity_error < 1e-8


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) * np.linspace(1, 3, dim) * scale).astype(np.float32).tolist()


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "d") for i, v in rows], f"vec_id long, embedding array<{kind}>, id int, dim string").repartition(4)


def test_equals_brute_force(spark):
    rows = list(enumerate(vectors(300, 9, 1)))
    rows += [(1000 + i, v) for i, v in rows[:40]] + [(2000, rows[0][1])] * 3  # copies count once in the fit
    odd = [(3000, None), (3001, [None] * 9), (3002, [float("nan")] * 9), (3003, [float("inf")] + [0.0] * 8), (3004, []), (3005, [1e300] * 9)]
    got = wh.whiten(frame(spark, rows + odd, "double")).collect()
    assert len(got) == 4 * len(rows)
    compare(got, brute(rows))


def test_lengths_are_fits_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(wh, "MODEL_NUMBERS", 1)
    a, b = list(enumerate(vectors(80, 5, 2))), [(500 + i, v) for i, v in enumerate(vectors(60, 3, 3))]
    got = wh.whiten(frame(spark, a + b)).collect()
    compare([r for r in got if r.vec_id < 500], brute(a))
    compare([r for r in got if r.vec_id >= 500], brute(b))
    assert len(got) == 80 * 4 + 60 * 3


def test_large_numbers_stay_exact(spark):
    rows = list(enumerate((np.array(vectors(50, 4, 4)) * 1e9).tolist()))
    compare_rows = wh.whiten(frame(spark, rows, "double")).collect()
    want = brute(rows)
    for r in compare_rows:
        assert r.deviation == (want[r.vec_id][1] if want[r.vec_id][1] < 2**63 else None)
        assert abs(r.whitened) == pytest.approx(abs(want[r.vec_id][2][r.component - 1]), abs=1e-7)


def test_no_spread(spark):
    got = wh.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 6
    two = wh.whiten(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect()
    assert {(r.vec_id, r.component): r.whitened and abs(round(r.whitened, 9)) for r in two} == {(1, 1): 1.0, (2, 1): 1.0, (1, 2): None, (2, 2): None}
    assert {r.identity_error < 1e-9 for r in two} == {True}


def test_empty_table(spark):
    assert wh.whiten(frame(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert wh.whiten(frame(spark, [(1, None)])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(1, 61), st.integers(0, 10**6))
def test_cross_products_are_exact(rows, dim, bits, seed):
    rng = random.Random(seed)
    u = [[rng.randrange(1 << bits) for _ in range(dim)] for _ in range(rows)]
    got = wh.cross_products(np.array(u, np.int64), bits)
    whole = sum(m.astype(object) << (wh.LIMB * k) for k, m in got.items())
    e = np.array([[*x, 1] for x in u], object)
    assert (np.triu(whole) == np.triu(e.T.dot(e))).all() and all((m >> wh.LIMB == 0).all() for m in got.values())
