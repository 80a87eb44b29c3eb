"""Whitening: counts and pairs against numpy, the whole operator against a plain recomputation, odd rows."""

import math

import numpy as np
import pytest

from spanforge.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, id string, component string"


def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 20, 64):
        g = rng.standard_normal((n, n))
        q = np.linalg.qr(g)[0]
        yield g @ g.T
        yield (q * np.r_[np.ones(n // 2), np.full(n - n // 2, 3.0)]) @ q.T
        yield (q * 10.0 ** -np.arange(n)) @ q.T
        yield g + g.T


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(2)
    for a in matrices():
        a = (a + a.T) / 2
        e = np.linalg.eigvalsh(a)
        for s in [*rng.choice(e, 3) + 1e-3 * rng.standard_normal(3), 0.1, e[0] - 1, e[-1] + 1]:
            if np.abs(e - s).min() > 1e-12:
                assert w.inertia(a, s) == (e > s).sum()


def test_leading_pairs():
    for a in matrices():
        a = (a + a.T) / 2
        e = np.linalg.eigvalsh(a)[::-1]
        values, rows = w.leading(a)
        assert len(values) == min(w.COMPONENTS, (e > len(a) * w.EPS * np.abs(a).sum(1).max()).sum())
        assert np.abs(values - e[: len(values)]).max(initial=0) <= 1e-13 * len(a) * np.abs(e).max()
        assert np.abs(rows @ rows.T - np.eye(len(values))).max(initial=0) < 1e-8
        assert np.abs(a @ rows.T - rows.T * values).max(initial=0) <= 1e-12 * np.abs(e).max()


def plain(vectors: dict[int, list[float]], k: int):
    u = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + w.OFFSET for i, v in vectors.items()}
    x = np.unique(np.stack(list(u.values())), axis=0)
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, {i: (int(((n * z - s) ** 2).sum()), (n * z - s) / n @ q / np.sqrt(e)) for i, z in u.items()}, e / np.trace(v)


def test_against_plain(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((6, 6))
    good = {i: (rng.standard_normal(6) @ mix).tolist() for i in range(300)}
    good |= {i: good[7] for i in range(300, 420)}
    bad = [(900, None), (901, [1.0] * 5 + [None]), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [1.0]), (905, []), (906, [1e30] * 6)]
    rows = [(i, v, "x", "y") for i, v in [*good.items(), *bad]] + [(5, good[5], None, None), (None, good[6], None, None)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), components=4).collect()
    n, want, explained = plain(good, 4)
    assert len(got) == 4 * (len(good) + 2)
    assert {r["vec_id"] for r in got} == {*good, None}
    sign = {}
    for r in got:
        z, c = want[6 if r["vec_id"] is None else r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, z[0])
        assert abs(abs(r["whitened"]) - abs(z[1][c])) < 1e-9
        if abs(z[1][c]) > 1e-3:
            assert sign.setdefault(c, np.sign(r["whitened"] * z[1][c])) == np.sign(r["whitened"] * z[1][c])
        assert abs(r["explained"] - explained[c]) < 1e-9 and r["identity_error"] < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, [1.0, 2.0], None, None)], [(1, [1.0, 2.0], None, None), (2, [1.0, 2.0], None, None)], [(1, [], None, None)]])
def test_nothing_to_whiten(spark, rows):
    assert w.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_rank_below_components(spark):
    rows = [(i, [float(i % 3), 2.0 * (i % 3), 0.0], None, None) for i in range(9)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9


def test_deviation_is_exact_or_null():
    m = w.Whitening(1 << 31, [0, 0], np.ones(1), np.ones((1, 2)), 1.0)
    assert m.deviation(np.array([[1, 0], [1, 1]])) == [1 << 62, None]
    assert w.Whitening(3, [1 << 62, 0], np.ones(1), np.ones((1, 2)), 1.0).apart(np.array([[1 << 61, 0]])).tolist() == [[3 * (1 << 61) - (1 << 62), 0]]
