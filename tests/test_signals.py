"""Signals against dense blocks, minima, states and the callers built on them."""

import numpy as np
import pytest

from binaxis.operators import minima as M
from binaxis.operators import signals as S
from binaxis.operators import states as T

N = 45


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(0)
    a = np.triu(rng.integers(0, 6, (N, N)) * (rng.random((N, N)) < 0.7)).astype(float)
    a[N - 1, N - 1] = 1
    return a + np.triu(a, 1).T


@pytest.fixture(scope="module")
def contacts(spark, dense):
    rows = [("c", 25_000, int(i) * 25_000, int(j) * 25_000, float(dense[i, j])) for i, j in zip(*np.nonzero(np.triu(dense)))]
    return spark.createDataFrame(rows, "chrom string, resolution int, bin_i long, bin_j long, count double")


@pytest.fixture(scope="module")
def c(contacts):
    return S.binned(contacts).persist()


def values(signal) -> np.ndarray:
    return np.array([np.nan if r["x"] is None else r["x"] for r in signal.orderBy("bin").collect()])


def test_insulation(c, dense):
    raw = np.log1p([dense[max(0, k - 5) : k + 1, k : k + 6].sum() for k in range(N)])
    assert values(S.insulation(c, 5)) == pytest.approx(raw / raw.mean(), abs=1e-8)


@pytest.mark.parametrize("w", [3, 5])
def test_bin_score(c, dense, w):
    wanted = [dense[k - w : k, k - w : k].mean() - dense[k + 1 : k + w + 1, k + 1 : k + w + 1].mean() if w <= k < N - w else np.nan for k in range(N)]
    assert values(S.bin_score(c, w)) == pytest.approx(wanted, abs=1e-8, nan_ok=True)


def test_directionality(c, dense):
    out = np.zeros(N)
    for k in range(10, N - 10):
        u, d = dense[k, k - 10 : k].sum(), dense[k, k + 1 : k + 11].sum()
        e = (u + d) / 2
        out[k] = np.sign(d - u) * ((d - e) ** 2 / e + (u - e) ** 2 / e)
    assert values(S.directionality(c, 10)) == pytest.approx(out, abs=1e-8)


def test_flank_mean(c, dense):
    wanted = [dense[k - 10 : k, k : k + 10].mean() if 10 <= k < N - 10 else 0 for k in range(N)]
    assert values(S.flank_mean(c)) == pytest.approx(wanted, abs=1e-8)


@pytest.mark.parametrize("n, sigma", [(30, 1.0), (30, 2.5), (4, 2.5), (1, 1.0)])
def test_smoothing_reflects(spark, n, sigma):
    x = np.random.default_rng(1).normal(size=n)
    rows = spark.createDataFrame([("c", 1, n, k, float(v)) for k, v in enumerate(x)], "chrom string, resolution int, n long, bin long, x double")
    weights = S.kernel(sigma)
    reach = weights[-1][0]
    wide = np.pad(x, reach, mode="symmetric") if n > 1 else np.full(2 * reach + 1, x[0])
    wanted = [sum(w * wide[k + reach + o] for o, w in weights) for k in range(n)]
    assert values(S.smooth(rows, sigma)) == pytest.approx(wanted, abs=1e-8)


@pytest.mark.parametrize("order", [1, 4])
def test_strict_minima(spark, order):
    x = np.random.default_rng(2).integers(0, 8, 60).astype(float)
    rows = spark.createDataFrame([("c", 1, 60, k, float(v)) for k, v in enumerate(x)], "chrom string, resolution int, n long, bin long, x double")
    wanted = [k for k in range(1, 59) if all(x[k] < x[j] for j in range(max(0, k - order), min(60, k + order + 1)) if j != k)]
    assert sorted(r["bin"] for r in S.strict_minima(rows, order).collect()) == wanted


def test_observed_over_expected(c, dense):
    means = {d: np.mean([v for v in np.diagonal(dense, d) if v > 0]) for d in range(N) if (np.diagonal(dense, d) > 0).any()}
    for r in S.observed_over_expected(c).collect():
        assert r["oe"] == pytest.approx(dense[r["i"], r["j"]] / means[r["j"] - r["i"]])


def test_size_means(c, dense):
    upper = np.triu(dense)
    for r in S.size_means(c, [0.5], 30).collect():
        d = r["d"]
        sums = [upper[a : a + d, a : a + d].sum() for a in range(N - d + 1)]
        assert r["n"] == len(sums)
        assert r["mu"] == (pytest.approx(np.mean(sums) / d**0.5) if len(sums) >= 30 else None)


def spaced_by_hand(points, least):
    kept, last, depth = [], 0, None
    for b, x in points:
        if b - last >= least:
            kept, last, depth = [*kept, b], b, x
        elif depth is not None and x < depth:
            kept, last, depth = [*kept[:-1], b], b, x
    return kept


def test_spaced(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        bins = sorted(rng.choice(60, 20, replace=False).tolist())
        points = [(b, float(rng.integers(0, 9))) for b in bins]
        df = spark.createDataFrame([(points,)], "c array<struct<bin:bigint,x:double>>")
        assert df.select(M.spaced(df["c"], 4)).first()[0] == spaced_by_hand(points, 4)


def covers(rows, n, res=25_000):
    rows = sorted((r["start"], r["end"]) for r in rows)
    return rows[0][0] == 0 and rows[-1][1] == n * res and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))


@pytest.fixture(scope="module")
def blocks(spark):
    """Three blocks of strong contacts on weak ones."""
    edges, rows = [0, 20, 45, 70], []
    for i in range(70):
        for j in range(i, 70):
            same = [k for k, (a, b) in enumerate(zip(edges, edges[1:])) if a <= i and j < b]
            rows.append(("c", 25_000, i * 25_000, j * 25_000, (15.0 + 5 * same[0] if same else 1.0) + ((i * 7 + j * 13) % 3) * 0.1))
    return S.binned(spark.createDataFrame(rows, "chrom string, resolution int, bin_i long, bin_j long, count double")).persist()


def starts(df):
    return sorted(r["start"] // 25_000 for r in df.collect())


def test_callers_find_blocks(blocks):
    from binaxis.operators import segment, spectral

    found = M.insulation_domains(blocks)
    assert covers(found.collect(), 70)
    assert all(any(abs(s - e) <= 2 for s in starts(found)) for e in (20, 45)), starts(found)
    assert all(any(abs(s - e) <= 2 for s in starts(M.flank_domains(blocks))) for e in (20, 45)), starts(M.flank_domains(blocks))
    cut = segment.flank_contrast_domains(blocks, 4, 40)
    assert covers(cut.collect(), 70) and {20, 45} <= set(starts(cut))
    spectral_cut = spectral.spectral_domains(blocks, 4)
    assert covers(spectral_cut.collect(), 70)


def test_block_contrast(blocks):
    found = M.block_contrast_domains(blocks).collect()
    ends = sorted((r["start"], r["end"]) for r in found)
    assert ends[0][0] == 0 and ends[-1][1] == 69 * 25_000


def test_contrast_of_blocks(spark, c, dense):
    doms = [(0, 10), (10, 18), (18, 44)]
    df = spark.createDataFrame([("c", 25_000, 3, s * 25_000, e * 25_000) for s, e in doms], "chrom string, resolution int, w int, start long, end long")
    inside = np.mean([dense[s:e, s:e].mean() for s, e in doms])
    between = np.mean([dense[s:e, a:b].mean() for s, e in doms for a, b in doms if a != s])
    assert M.contrast(c, df).first()["ratio"] == pytest.approx(inside / (between + 1e-9), abs=1e-5)


def test_states_follow_the_signal():
    rng = np.random.default_rng(0)
    truth = np.repeat([2, 1, 0, 2, 0, 1, 2, 0], 25)
    found = T.fit_states(np.array([-6.0, 0.0, 6.0])[truth] + rng.normal(size=200))
    assert (found == truth).mean() > 0.97


def pattern_by_hand(states, least):
    runs, out, i = [], [], 0
    for k, s in enumerate(states):
        if runs and runs[-1][0] == s:
            runs[-1][2] = k
        else:
            runs.append([s, k, k])
    while i < len(runs) - 1:
        to = next((k for k in range(i + 1, len(runs)) if runs[k][0] == 0), None) if runs[i][0] == 2 else None
        if to is None:
            i += 1
            continue
        if runs[to][2] - runs[i][1] + 1 >= least:
            out.append((runs[i][1], runs[to][2] + 1))
        i = to
    return out


def transitions_by_hand(states, least):
    marks, n = {0, len(states)}, len(states)
    for i in range(1, n):
        j = i
        while states[i - 1] == 2 and j < n and states[j] == 1:
            j += 1
        if states[i - 1] == 2 and j < n and states[j] == 0:
            marks.add(j)
    marks = sorted(marks)
    return [(a, b) for a, b in zip(marks, marks[1:]) if b - a >= least]


def test_patterns_of_states(spark):
    rng = np.random.default_rng(4)
    rows, wanted, moved = [], {}, {}
    for k in range(8):
        states = np.repeat(rng.integers(0, 3, 20), rng.integers(1, 4, 20)).tolist()
        rows += [(f"c{k}", 1, len(states), b, s) for b, s in enumerate(states)]
        wanted[f"c{k}"], moved[f"c{k}"] = pattern_by_hand(states, 3), transitions_by_hand(states, 2)
    df = spark.createDataFrame(rows, "chrom string, resolution int, n long, bin long, state int")
    runs, got, changed = M.islands(df), {k: [] for k in wanted}, {k: [] for k in wanted}
    for r in M.pattern_domains(runs, 3).orderBy("s").collect():
        got[r["chrom"]].append((r["s"], r["e"]))
    for r in M.transition_domains(runs, M.spine_of(df), 2).orderBy("s").collect():
        changed[r["chrom"]].append((r["s"], r["e"]))
    assert got == wanted and changed == moved


def test_state_domains_and_short_chromosomes(blocks):
    assert T.state_domains(blocks, 10, 4).count() > 0
    assert M.insulation_domains(blocks.filter("j < 8")).count() == 0
    assert T.state_domains(blocks.filter("j < 8")).count() == 0


def test_symmetry_and_masks(contacts):
    both = S.symmetrized(contacts)
    assert both.count() == 2 * contacts.count() - contacts.filter("bin_i = bin_j").count()
    again = S.merged_pairs(both, "mean")
    key = ["chrom", "resolution", "bin_i", "bin_j", "count"]
    assert again.select(key).exceptAll(contacts.select(key)).count() == 0
    assert S.distance_masked(contacts, 3).filter("bin_j - bin_i >= 75000").count() == 0
