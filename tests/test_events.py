"""Sessions cut day by day are those of one pass over each key."""

import random

import pytest

from binaxis.sources import events as E

DDL = "algorithm string, chrom string, event_id long, t long"


def brute(rows, factor):
    keys = {}
    for algorithm, chrom, _, t in rows:
        keys.setdefault((algorithm, chrom), []).append(t)
    out = []
    for key, ts in keys.items():
        ts.sort()
        parts = [[ts[0]]]
        for a, b in zip(ts, ts[1:]):
            if (b - a) * len(ts) > factor * (ts[-1] - ts[0]):
                parts.append([])
            parts[-1].append(b)
        out += [(*key, p[0] // E.GRID * E.GRID, (p[-1] // E.GRID + 1) * E.GRID) for p in parts]
    return sorted(out, key=str)


def rows_of(seed):
    """Ties, null keys, seconds about midnight, days without events, keys of one event."""
    rng = random.Random(seed)
    near = [d * E.DAY + s for d in (0, 1, 2, 5, 9) for s in (-1, 0, 1)]
    keys = [("a", "x"), ("a", None), (None, "x"), (None, None)]
    rows = [(*rng.choice(keys), i, rng.choice([rng.randrange(10 * E.DAY), max(0, rng.choice(near)), rng.randrange(5) * 3])) for i in range(300)]
    return rows + [("one", "x", 1, 5 * E.DAY), ("same", "x", 1, 7), ("same", "x", 2, 7), ("two", "x", 1, 0), ("two", "x", 2, 9 * E.DAY)]


@pytest.mark.parametrize("factor", [1, 2, 5])
def test_sessions(spark, factor):
    rows = rows_of(factor)
    assert sorted(map(tuple, E.sessions(spark.createDataFrame(rows, DDL), factor).collect()), key=str) == brute(rows, factor)


def test_sessions_of_nothing(spark):
    out = E.sessions(spark.createDataFrame([], DDL), 2)
    assert out.columns == ["algorithm", "chrom", "start", "end"] and out.count() == 0
