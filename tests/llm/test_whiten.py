"""Whitening against numpy's dense eigendecomposition, with exact sums."""

import math

import numpy as np
import pytest

from scorelake.llm.whiten import Spectrum, rank_one, whiten


def updates(rows):
    d, u = np.zeros(rows.shape[1]), np.eye(rows.shape[1])
    for v in rows:
        d, u = rank_one(d, u, v)
    return d, u


@pytest.mark.parametrize("kind", ["full", "few", "zeros", "scales", "axes", "equal", "one", "near"])
def test_rank_one_updates(kind):
    """Eigenvalues and vectors of sums of squares: with equal and nearly equal eigenvalues, zero parts and twelve orders of magnitude."""
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(150, 24))
    if kind == "few":
        rows = rows[:10]
    elif kind == "zeros":
        rows[:, ::2] = 0
    elif kind == "scales":
        rows *= 10.0 ** rng.integers(-6, 7, (150, 1))
    elif kind == "axes":
        rows = np.eye(24)[rng.integers(0, 24, 150)]
    elif kind == "equal":
        rows = np.repeat(rows[:3], 50, 0)
    elif kind == "one":
        rows = rows[:, :1]
    elif kind == "near":
        rows = np.vstack([np.eye(24)] * 4 + [1e-9 * rows])
    d, u = updates(rows)
    want = rows.T @ rows
    assert np.allclose(d, np.linalg.eigvalsh(want), atol=1e-12 * d[-1], rtol=0)
    assert np.abs(u.T @ u - np.eye(len(d))).max() < 1e-12
    assert np.abs(u * d @ u.T - want).max() < 1e-12 * d[-1]


def test_merged_spectra_and_blocks():
    """A vector an update, blocks of several sizes and merged parts agree with the scatter about the mean, also far from zero."""
    rng = np.random.default_rng(8)
    x = rng.integers(-50, 50, (230, 9)) + 10**6
    y = x - x.mean(0)
    for block in (1, 4, 100, 500):
        parts = []
        for own in (x[:1], x[1:120], x[120:]):
            s = Spectrum.none(9)
            for a in range(0, len(own), block):
                s.add(own[a : a + block])
            parts.append(s)
        for p in parts[1:]:
            parts[0].merge(p)
        s = parts[0]
        assert s.n == 230
        assert (s.sums == x.sum(0)).all()
        assert np.abs(s.vectors * s.values @ s.vectors.T - y.T @ y).max() < 1e-9 * s.values[-1]


def plain(rows, components=4):
    """Rows (id, component, n, deviation, |whitened|, explained) by exact sums and a dense eigendecomposition."""
    held = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not held:
        return {}
    lengths = [len(v) for _, v in held]
    dims = max(set(lengths), key=lambda k: (lengths.count(k), k))
    held = [(i, v) for i, v in held if len(v) == dims]
    fit = sorted({tuple(v) for _, v in held})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = lambda v: [n * a - s for a, s in zip(v, sums, strict=True)]
    y = np.array([off(v) for v in fit], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for place, (i, v) in enumerate(held):
        d = sum(a * a for a in off(v))
        w = np.array(off(v), float) / n @ u
        for k in range(min(components, dims)):
            if e[k] > 1e-9 * max(e.sum(), 0):
                out[place, i, k + 1] = (n, d if d < 2**63 else None, abs(w[k]) / math.sqrt(e[k]), e[k] / e.sum())
    return out


def check(df, rows, **options):
    got = whiten(df, **options).collect()
    want = plain(rows)
    key = lambda r: (str(r[0]), r[1], r[2][:2] if r[2][1] is not None else (r[2][0], -1), round(r[2][2], 6))
    a = sorted([(r.vec_id, r.component, (r.n, r.deviation, abs(r.whitened), r.explained)) for r in got], key=key)
    b = sorted([(i, k, v) for (_, i, k), v in want.items()], key=key)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for (*_, x), (*_, y) in zip(a, b, strict=True):
        assert x[:2] == y[:2]
        assert x[2] == pytest.approx(y[2], rel=1e-7, abs=1e-7)
        assert x[3] == pytest.approx(y[3], rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)
    return got


SCHEMA = "vec_id long, embedding array<float>, n int, component string"


@pytest.mark.parametrize("block", [1, 16, 8192])
def test_against_dense(spark, block):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=8) * np.arange(1, 9))]) for i in range(300)]
    rows += rows[:40] + [(1000 + i, v) for i, v in rows[:30]] + [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2004, [float("-inf")] + [0.0] * 7), (2005, []), (2006, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(20)
    got = check(df, rows, block=block)
    assert {type(r.component) for r in got} == {int}
    # The same axis and sign for all rows: covariance of the fitted rows' values is the identity.
    one = {}
    for r in got:
        one.setdefault((tuple(next(v for i, v in rows if i == r.vec_id)),), {})[r.component] = r.whitened
    w = np.array([[o[k] for k in (1, 2, 3, 4)] for o in one.values()])
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-6


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_low_rank_and_far_from_zero(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(-9, 9, (60, 2))
    x = np.hstack([base, base[:, :1] * 2, np.full((60, 1), 3_000_000)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = check(spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>"), rows)
    assert {r.component for r in got} == {1, 2}


def test_large_entries(spark):
    """Deviations past 63 bits are null, the others exact."""
    rows = [(i, [float(i % 7) * 1e3, float(i)]) for i in range(400)] + [(999, [1e6, 1.0])]
    got = check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)
    assert {r.deviation is None for r in got} == {True, False}
    spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 5.0])], "vec_id long, embedding array<double>").transform(whiten).collect()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [0.001]), (2, [0.002])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []
