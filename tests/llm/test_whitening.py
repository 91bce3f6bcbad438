"""Whitening against a covariance made of exact fractions and numpy's own."""

import math
import random

import numpy as np
import pytest

from taleweave.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component int, n string"


def rows_of(vectors):
    return [(k, v and [None if c is None else float(c) for c in v], 7, "x") for k, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(4)
    spread = [3.0, 1.5, 1.0, 0.4, 0.2, 0.1]
    out = [[r.gauss(0.3, s) for s in spread] for _ in range(400)]
    out += [out[5]] * 150 + [[x + 1e-7 for x in out[6]]]
    return out + [None, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0], [1e300] * 6, [0.5, -0.25]]


def whole(v):
    return tuple(math.floor(256 * c) for c in v) + (0,) * (6 - len(v))


def test_whitening(spark, vectors):
    table = spark.createDataFrame([*rows_of(vectors), (None, vectors[0], 1, "y")], SCHEMA).repartition(5)
    got = whitening.whiten(table).collect()
    kept = {k: whole(v) for k, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) and abs(c) < 1e290 for c in v)}
    fit = sorted(set(kept.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert len(got) == 4 * (len(kept) + 1) and {x.n for x in got} == {n} and sum(x.vec_id is None for x in got) == 4
    values, axes = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    by = {(x.vec_id, x.component): x for x in got}
    for c in range(4):
        plain = {k: (np.array(x) - np.array(s) / n) @ axes[:, c] / math.sqrt(values[c]) for k, x in kept.items()}
        sign = 1 if plain[0] * by[0, c + 1].whitened > 0 else -1
        for k, w in plain.items():
            x = by[k, c + 1]
            assert x.whitened == pytest.approx(sign * w, abs=1e-9) and x.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert x.deviation == sum((n * a - b) ** 2 for a, b in zip(kept[k], s, strict=True)) and x.identity_error < 1e-9


def test_merging_equals_the_whole():
    r = np.random.default_rng(1)
    rows = r.integers(-1000, 1000, (997, 5)) + 10**9
    found = whitening.Moments(0, np.zeros(5, object), np.zeros((5, 5)))
    for part in np.array_split(rows, 13):
        found = whitening.merge(found, whitening.moments(part))
    centred = (rows - 10**9) - (rows - 10**9).mean(0)
    assert found.n == 997 and found.total.tolist() == rows.sum(0).tolist()
    assert np.allclose(found.scatter, centred.T @ centred, rtol=1e-12)


def test_packed_rows_are_the_rows():
    rows = np.array([[0, -128, 127], [1, 128, 0], [1 << 20, 0, 0], [-(1 << 62), 1, 2], [0, 0, -32769]])
    packed = whitening.packed(rows)
    assert [len(p) for p in packed] == [3, 6, 12, 24, 12]
    import pyarrow as pa

    assert whitening.unpacked(pa.array(packed, pa.binary()), 3).tolist() == rows.tolist()


def test_huge_sums_stay_exact(spark):
    vectors = [[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**50), 3.0], [0.0, 0.0]]
    fit = [tuple(math.floor(256 * c) for c in v) for v in vectors]
    s = [sum(c) for c in zip(*fit, strict=True)]
    for x in whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect():
        want = sum((4 * a - b) ** 2 for a, b in zip(fit[x.vec_id], s, strict=True))
        assert x.deviation == (want if want < 2**63 else None)


@pytest.mark.parametrize("vectors,axes", [([[1.0, 2.0, 3.0]] * 3, 0), ([[1.0, 0, 0], [2.0, 0, 0], [4.0, 0, 0]], 1), ([[0.5, 0.1], [0.2, 0.9], [0.3, 0.3]], 2)])
def test_axes_without_variance(spark, vectors, axes):
    got = whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect()
    assert len(got) == len(vectors) * min(4, len(vectors[0]))
    assert {x.component for x in got if x.whitened is not None} == set(range(1, axes + 1))
    assert all(x.explained == 0 for x in got if x.whitened is None) and all(x.identity_error < 1e-9 for x in got)


def test_no_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, "")], SCHEMA)).collect() == []
