"""Dynamic programming, schedules, hierarchies and spectral parts against brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binaxis.operators import hierarchy as H
from binaxis.operators import multiscale as X
from binaxis.operators import segment as G
from binaxis.operators import signals as S
from binaxis.operators import spectral as P


def triangle(seed: int, n: int) -> np.ndarray:
    return np.triu(np.random.default_rng(seed).random((n, n)))


def parts(a: np.ndarray):
    i, j = np.nonzero(np.triu(np.ones_like(a)))
    return i, j, a[i, j]


@pytest.mark.parametrize("most", [4, 9, 30])
def test_window_sums(most):
    a = triangle(0, 9)
    t = G.window_sums(*parts(a), 9, most)
    for d in range(1, min(most, 9) + 1):
        for s in range(9 - d + 1):
            assert t[d, s] == pytest.approx(a[s : s + d, s : s + d].sum())


def test_flank_scores():
    n, a = 14, triangle(1, 14)
    full = a + np.triu(a, 1).T
    scores = G.flank_scores(*parts(a), n, 2, 6)
    for d in range(2, 7):
        for s in range(n - d + 1):
            e, lo, hi = s + d, max(0, s - d), min(n, s + 2 * d)
            area = d * ((s - lo) + (hi - e))
            flank = (full[lo:s, s:e].sum() + full[s:e, e:hi].sum()) / area if area else 0
            assert scores[d, s] == pytest.approx(full[s:e, s:e].mean() - flank)


def compositions(n, least, most):
    if n == 0:
        yield []
    for d in range(least, min(most, n) + 1):
        for rest in compositions(n - d, least, most):
            yield [d, *rest]


@pytest.mark.parametrize("seed, penalty", [(0, 0.0), (1, 0.2), (2, 1.0)])
def test_cover_is_the_best(seed, penalty):
    n = 12
    scores = G.flank_scores(*parts(triangle(seed, n)), n, 2, 5)

    def worth(lengths):
        ends = np.cumsum([0, *lengths])
        return sum(scores[d, a] - penalty for d, a in zip(lengths, ends))

    found = G.cover(scores, penalty, 2, n)
    assert found[0][0] == 0 and found[-1][1] == n and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert worth([e - s for s, e in found]) == pytest.approx(max(map(worth, compositions(n, 2, 5))))


def test_cover_draws_the_last_segment_out():
    scores = np.full((4, 8), -np.inf)
    scores[3, [0, 3]] = 1.0
    assert G.cover(scores, 0.1, 3, 7) == [(0, 3), (3, 7)]
    assert G.cover(np.full((4, 8), -np.inf), 0.1, 3, 7) == [(0, 7)]


def sets_of(q):
    n = q.shape[1] - 1
    windows = [(a, a + d - 1) for d in range(2, q.shape[0]) for a in range(n - d + 1) if q[d, a] > -np.inf]
    for k in range(len(windows) + 1):
        for chosen in itertools.combinations(windows, k):
            chosen = sorted(chosen)
            gaps = [b[0] - a[1] - 1 for a, b in zip(chosen, [*chosen[1:], (n, n)])]
            if all(g >= 0 and g != 1 for g in gaps):  # a gap after a window has two bins at least
                yield sum(q[e - s + 1, s] for s, e in chosen), chosen


@pytest.mark.parametrize("seed", range(6))
def test_best_sets(seed):
    sums = G.window_sums(*parts(triangle(seed, 7) - 0.4), 7, 7)
    q = X.qualities(sums, 0.5, 2)
    every = sorted(sets_of(q), key=lambda x: -x[0])
    found = X.best_set(q)
    assert sum(q[e - s + 1, s] for s, e in found) == pytest.approx(every[0][0])
    top = X.best_sets(q, 4)
    assert [s for s, _ in top] == pytest.approx([s for s, _ in every[:4]])
    assert len({tuple(w) for _, w in top}) == len(top)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 8), st.integers(1, 9)), max_size=9))
def test_schedule(rows):
    rows = [(a, a + d, float(w)) for a, d, w in rows]
    best = 0.0
    for k in range(len(rows) + 1):
        for chosen in itertools.combinations(rows, k):
            chosen = sorted(chosen)
            if all(a[1] < b[0] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(r[2] for r in chosen))
    found = X.schedule(rows)
    weights = {}
    for a, b, w in rows:
        weights[a, b] = max(w, weights.get((a, b), 0))
    assert all(a[1] < b[0] for a, b in zip(found, found[1:])) and sum(weights[f] for f in found) == pytest.approx(best)


def test_gammas():
    assert X.gammas_up_to(0.1) == [0.0, 0.05, 0.1] and len(X.gammas_up_to(0.5)) == 11


def contacts(spark, n=36):
    a = triangle(5, n) * 9 + 1
    return S.binned(spark.createDataFrame([("c", 10_000, int(i) * 10_000, int(j) * 10_000, float(v)) for i, j, v in zip(*parts(a))], "chrom string, resolution int, bin_i long, bin_j long, count double"))


def test_gamma_domains(spark):
    c = contacts(spark)
    half, whole = X.gamma_domains(c, [0.1, 0.3], 10), X.gamma_domains(c, [0.1, 0.3], 10, inclusive_end=True)
    assert sorted((r["gamma"], r["start"], r["end"] - 1) for r in half.collect()) == sorted((r["gamma"], r["start"], r["end"]) for r in whole.collect())
    sizes = spark.createDataFrame([("c", 360_000)], "chrom string, size long")
    chosen = X.choose_gamma(X.stability(half), sizes).first()
    assert chosen["gamma"] in (0.1, 0.3)
    assert {tuple(r) for r in X.multiscale_domains(c, sizes, [0.1, 0.3], 10).collect()} <= {tuple(r)[1:] for r in half.collect()}


def test_penalty_choice(spark):
    rows = [("c", 1000, 20_000, k, p, s, s) for k, (p, n) in enumerate([(2.0, 3), (1.0, 18), (0.5, 30)]) for s in range(n)]
    swept = spark.createDataFrame(rows, "chrom string, n_bins long, resolution int, ord int, penalty double, s long, e long")
    assert G.choose_penalty(swept).first()["ord"] == 1  # 16 to 50 are on target for 20 Mb
    assert G.choose_penalty(swept.filter("ord = 0")).first()["ord"] == 0


def test_elbow(spark):
    rows = [("c", 1000, k, float(k), s, s) for k, n in enumerate([300, 151, 121, 61, 51, 10]) for s in range(n)]
    swept = spark.createDataFrame(rows, "chrom string, resolution int, ord int, penalty double, s long, e long")
    assert P.choose_elbow(swept).first()["ord"] == 3
    assert P.choose_elbow(swept.filter("ord in (0, 5)")).first()["ord"] == 5


@pytest.mark.parametrize("penalty", [0.0, 0.5, 5.0])
def test_least_squares(penalty):
    rows = np.random.default_rng(0).normal(size=(10, 2))
    costs = P.Costs(rows)

    def total(lengths):
        ends = np.cumsum([0, *lengths])
        return sum(((rows[a:b] - rows[a:b].mean(0)) ** 2).sum() + penalty for a, b in zip(ends, ends[1:]))

    found = P.least_squares_cut(costs, penalty, 3)
    assert found[-1] == 10 and total(np.diff([0, *found])) == pytest.approx(min(map(total, compositions(10, 3, 10))))


def test_embedding_has_unit_rows_and_known_span():
    w = P.affinity(np.random.default_rng(1).normal(size=(30, 5)), 6)
    assert (w == w.T).all() and (np.diag(w) == 0).all()
    e = P.embed(w, 4)
    assert e.shape == (30, 4) and np.linalg.norm(e, axis=1) == pytest.approx(np.ones(30))


ROWS = [(0, 100, 1), (0, 40, 2), (40, 100, 2), (0, 20, 3), (20, 40, 3), (40, 60, 3), (60, 100, 3)]


def test_division():
    assert H.divide(ROWS, 100, 1, 1, 3) == [(0, 100, 1)]
    assert H.divide(ROWS, 100, 4, 4, 3) == [(0, 20, 3), (20, 40, 3), (40, 60, 3), (60, 100, 3)]
    assert H.divide(ROWS, 100, 3, 3, 3)[:1] == [(0, 20, 3)] or len(H.divide(ROWS, 100, 3, 3, 3)) in (2, 4)
    assert H.divide([], 100, 3, 3, 3) == [] and H.divide([(0, 2, 1)], 100, 1, 1, 3) == []


def test_children(spark):
    df = spark.createDataFrame([("c", *r) for r in ROWS], "chrom string, start_bin int, end_bin int, depth int")
    pairs = {(r["parent_start"], r["parent_end"], r["start_bin"], r["end_bin"]) for r in H.children(df, ["chrom"], 30).collect()}
    assert pairs == {(0, 100, 0, 40), (0, 100, 40, 100), (40, 100, 60, 100)}


def test_hierarchy_domains(spark):
    df = spark.createDataFrame([("c", 10, s + 1, e, d, 0.0, 0.0) for s, e, d in ROWS], "chrom string, resolution int, start_bin int, end_bin int, depth int, score1 double, score2 double")
    n = spark.createDataFrame([("c", 10, 90)], "chrom string, resolution int, n long")
    out = sorted((r["start"], r["end"]) for r in H.hierarchy_domains(df, n, 3, 1, 1).collect())
    assert out == [(0, 900)]
