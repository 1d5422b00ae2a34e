"""Whitening against direct integer products and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skywake.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, x string, n long, white double"


def _table(spark, rows):
    return spark.createDataFrame([(k, v, 1, 9, "x", 7, 0.5) for k, v in rows], SCHEMA)


def _fits(vector):
    return vector is not None and len(vector) > 0 and all(c is not None and math.isfinite(c) and abs(c * 256) <= 2.0**53 for c in vector)


def _expected(rows):
    """By vec_id and length: n, deviation, whitened coordinates up to their signs, explained."""
    held = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if _fits(v)]
    out = {}
    for dim in {len(x) for _, x in held}:
        distinct = sorted({tuple(x) for _, x in held if len(x) == dim})
        n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
        mean = np.array([s / n for s in sums])
        fit = np.array(distinct, float) - mean
        values, vectors = np.linalg.eigh(fit.T @ fit / n)
        values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
        for k, x in held:
            if len(x) == dim:
                deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
                white = ((np.array(x, float) - mean) @ vectors) / np.sqrt(np.maximum(values, 1e-300))
                out.setdefault((k, dim), []).append((n, deviation, white, values / max(1e-300, (fit**2).sum() / n)))
    return out


def _found(rows):
    held = {}
    for r in rows:
        held.setdefault((r.vec_id, r.deviation), []).append(r)
    return held


@pytest.mark.parametrize("low, high, rows, dims", [(-150, 133, 700, 9), (0, 1, 70, 3), (-(2**53), 2**53, 130, 4), (5, 6, 65, 2), (-3, 90, 1, 5)])
def test_sliced_products_are_the_products(low, high, rows, dims):
    x = np.random.default_rng(rows).integers(low, high, (rows, dims))
    whole = np.hstack([np.ones((rows, 1), int), x]).astype(object)
    assert (whitening.moments(x) == whole.T.dot(whole)).all()


@pytest.mark.parametrize("value", [0, 1, -1, 2**40, -(2**40), 2**160 + 12345, -(2**170) - 99])
def test_limbs_add_up(value):
    assert sum(part << whitening.LIMB * k for k, part in enumerate(whitening.limbs(value))) == value


def test_all_vectors_are_whitened(llm):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 6)) @ mix)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (700, rows[3][1]), (701, None), (702, []), (703, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (704, [math.nan] * 6)]
    rows += [(705, [math.inf] + [0.0] * 5), (706, [1e300] + [0.0] * 5), (707, [-0.0] * 6)]
    held = whitening.whitened(_table(llm, rows)).collect()
    expected = _expected(rows)
    assert len(held) == 4 * sum(len(e) for e in expected.values()) == 4 * 304
    assert max(r.identity_error for r in held) < 1e-9 and len({r.identity_error for r in held}) == 1
    signs = {}
    for (key, deviation), found in _found(held).items():
        n, exact, white, explained = expected[key, 6][0]
        assert (found[0].n, deviation) == (n, exact) == (301, exact)
        for r in found:
            turn = signs.setdefault(r.component, np.sign(white[r.component - 1] * r.whitened))
            assert r.whitened == pytest.approx(turn * white[r.component - 1], abs=1e-8)
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    assert sorted(r.component for r in held if r.vec_id == 1) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_lengths_flat_directions_and_large_components(llm):
    rng = np.random.default_rng(6)
    plane = [(k, [float(a), float(b), float(a + b), 1.0, 0.0]) for k, (a, b) in enumerate(rng.normal(size=(40, 2)).round(1))]
    short = [(100 + k, [float(k)]) for k in range(5)]
    same = [(200, [3.0, 4.0])] * 3
    wide = [(300 + k, [1e12 * k, 1.0, -1e12 * k * k]) for k in range(4)]
    rows = [*plane, *short, *same, *wide]
    held = whitening.whitened(_table(llm, rows)).collect()
    expected = _expected(rows)
    for r in held:
        size = next(d for k, d in expected if k == r.vec_id)
        n, deviation, white, explained = expected[r.vec_id, size][0]
        assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
        if explained[r.component - 1] > 1e-6:
            assert abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), abs=1e-6)
        else:
            assert r.whitened == 0 or abs(r.whitened) < 10
    assert {r.component for r in held if r.vec_id < 100} == {1, 2, 3, 4} and {r.component for r in held if 100 <= r.vec_id < 200} == {1}
    assert all(r.whitened == 0 and r.explained == 0 for r in held if r.vec_id == 200)
    assert max(r.identity_error for r in held) < 1e-4


def test_an_empty_table_gives_no_rows(llm):
    assert whitening.whitened(_table(llm, [(1, None)])).count() == 0
    assert whitening.whitened(_table(llm, [(1, None)]).where(F.lit(False))).count() == 0
