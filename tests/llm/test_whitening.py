"""Op 13 against an eigendecomposition of the exact covariance."""

import numpy as np
import pytest

from runwise.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, n long, place int, value double, component int, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 1, 1.0, 1, 1) for i, v in rows], SCHEMA)


def brute(vectors):
    x = np.array([[int(np.floor(float(np.float32(c)) * 1024)) + 100000 for c in v] for v in vectors], dtype=object)
    n = len(x)
    s = x.sum(axis=0)
    d = n * x - s
    a = (d / n).astype(float)
    e, u = np.linalg.eigh(a.T @ a / n)
    return n, (d * d).sum(axis=1), a, e[::-1], u[:, ::-1]


def check(spark, rows, good=None):
    good = rows if good is None else good
    got = sorted(W.report(frame(spark, rows)).collect(), key=lambda r: (str(r.vec_id), r.component))
    n, deviation, a, e, u = brute([v for _, v in good])
    top = min(8, a.shape[1])
    assert len(got) == len(good) * top and {r.n for r in got} == {n}
    order = sorted(range(n), key=lambda k: str(good[k][0]))
    live = [k for k in range(top) if e[k] > 1e-9 * max(e[0], 1e-300)]
    for c in range(top):
        mine = [r for r in got if r.component == c + 1]
        assert sorted(r.deviation_exact for r in mine) == sorted(deviation)
        assert all(r.deviation == (r.deviation_exact if r.deviation_exact < 1 << 63 else None) for r in mine)
        assert mine[0].identity_error <= 1e-6
        if c not in live:
            assert all(r.whitened is None and r.explained == pytest.approx(0, abs=1e-9) for r in mine)
            continue
        assert mine[0].explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
        if len({i for i, _ in good}) == n and (c == 0 or e[c - 1] - e[c] > 1e-6 * e[0]) and (c + 1 == len(e) or e[c] - e[c + 1] > 1e-6 * e[0]):
            w = (a @ u[:, c] / np.sqrt(e[c]))[order]
            v = np.array([r.whitened for r in mine])
            assert np.abs(v - w * np.sign(v @ w)).max() < 1e-7
    return got


def rows_of(m, first=0):
    return [(first + k, [float(c) for c in row]) for k, row in enumerate(m)]


def test_equals_eigendecomposition(llm):
    rng = np.random.default_rng(2)
    check(llm, rows_of(rng.normal(0, 0.2, (400, 20)) * np.linspace(1, 3, 20)))


def test_badly_conditioned(llm):
    rng = np.random.default_rng(3)
    m = rng.normal(0, 1, (300, 12)) * 10.0 ** np.linspace(4, -1, 12)
    check(llm, rows_of(m))


def test_rank_below_dimension_and_ties(llm):
    rng = np.random.default_rng(4)
    base = rng.integers(-4, 4, (60, 3)) / 4
    check(llm, rows_of(np.hstack([base, base[:, ::-1], np.zeros((60, 4))])))
    check(llm, rows_of(rng.normal(0, 1, (5, 10))))
    check(llm, rows_of(np.repeat(rng.normal(0, 1, (1, 4)), 6, axis=0)))
    check(llm, [(1, [0.5, 0.25])])


def test_odd_rows(llm):
    rng = np.random.default_rng(5)
    good = rows_of(rng.normal(0, 0.3, (50, 9)))
    bad = [(90, None), (91, [None] + [0.0] * 8), (92, [float("nan")] * 9), (93, [float("inf")] + [0.0] * 8), (94, []), (95, [0.1] * 7), (None, None),
           (96, [1e30] + [0.0] * 8)]
    check(llm, good + bad, good)
    repeated = good + good[:5]
    check(llm, repeated)
    with_null = good + [(None, [0.1 * k for k in range(9)])]
    check(llm, with_null)


def test_hot_vector_and_empty_table(llm):
    rng = np.random.default_rng(6)
    check(llm, rows_of(np.vstack([rng.normal(0, 0.3, (100, 10)), np.tile(rng.normal(0, 0.3, (1, 10)), (200, 1))])))
    assert W.report(frame(llm, [])).count() == 0
    assert W.report(frame(llm, [(1, None)])).columns == W.report(frame(llm, [(1, [1.0])])).columns


def test_deviation_beyond_a_long_is_exact():
    x = np.array([[0, 1 << 40], [3, 5]])
    n = 1 << 22
    sums = np.array([7, 1 << 50])
    assert W.deviations(x, n, sums) == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]


def test_partitioning_doesnt_matter(llm):
    rng = np.random.default_rng(7)
    df = frame(llm, rows_of(rng.normal(0, 0.3, (300, 10))))
    a, b = ({(r.vec_id, r.component): r.whitened for r in W.report(df.repartition(k)).collect()} for k in (2, 9))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9
