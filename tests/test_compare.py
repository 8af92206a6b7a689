"""Comparison tables: cases by hand, symmetry, monotonicity, empty sides, and the plan of the range join."""

import random

import pytest
from pyspark.sql import functions as F

from binaxis import schema
from binaxis.operators import compare as C
from binaxis.operators.range_join import near, overlaps

RES = 50_000
A = [(0, 500_000), (500_000, 1_000_000), (1_000_000, 2_000_000), (2_000_000, 3_000_000)]
FAR = [(9_000_000, 9_500_000)]


def domains(spark, lists):
    return spark.createDataFrame([(a, "chr1", RES, s, e) for a, ds in lists.items() for s, e in ds], schema.DOMAINS)


def keys(spark, *names):
    return spark.createDataFrame([(n, "chr1", RES) for n in names], "algorithm string, chrom string, resolution int")


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame(list(schema.HG19.items()), "chrom string, size long")


def test_basic(spark, sizes):
    out = {r["algorithm"]: r for r in C.basic_stats(domains(spark, {"a": A}), sizes, keys=keys(spark, "a", "none")).collect()}
    a, none = out["a"], out["none"]
    assert (a["n_tads"], a["median_size_kb"], a["mean_size_kb"], a["std_size_kb"]) == (4, 750.0, 750.0, 250.0)
    assert a["coverage_pct"] == pytest.approx(100 * 3e6 / 249_250_621)
    assert (none["n_tads"], none["median_size_kb"], none["coverage_pct"], none["pct_consensus_bnd"]) == (0, None, 0.0, 0.0)


@pytest.mark.parametrize("b, wanted", [(A, 1.0), (FAR, 0.0), (A[:2] + FAR, 2 / 5), ([], 0.0)])
def test_jaccard(spark, b, wanted):
    both = domains(spark, {"a": A, "b": b})
    for x, y in (("a", "b"), ("b", "a")):
        row = C.pairwise_jaccard(both, ordered=True, keys=keys(spark, "a", "b")).filter((F.col("algo_a") == x) & (F.col("algo_b") == y)).first()
        assert row["jaccard"] == pytest.approx(wanted)


def test_both_empty(spark):
    none = domains(spark, {"a": A}).limit(0)
    assert [r["jaccard"] for r in C.pairwise_jaccard(none, keys=keys(spark, "a", "b")).collect()] == [1.0]
    assert [r["jaccard"] for r in C.pairwise_jaccard(none, both_empty=0.0, keys=keys(spark, "a", "b")).collect()] == [0.0]


@pytest.mark.parametrize("b, ab, ba", [(A, 100, 100), (FAR, 0, 0), ([(s + 40_000, e + 40_000) for s, e in A], 100, 100), ([], 0, None)])
def test_overlap(spark, b, ab, ba):
    row = C.pairwise_overlap(domains(spark, {"a": A, "b": b}), keys=keys(spark, "a", "b")).first()
    assert (row["overlap_a_in_b"], row["overlap_b_in_a"]) == (ab, ba)


def test_matrix(spark):
    m = {r["algo_a"]: r for r in C.pairwise_matrix(domains(spark, {"a": A, "b": A[:3] + FAR})).collect()}
    assert m["a"]["a"] == m["b"]["b"] == 1.0 and m["a"]["b"] == m["b"]["a"] == pytest.approx(3 / 5)
    rates = {r["algo_a"]: r for r in C.pairwise_matrix(domains(spark, {"a": A, "b": A}), "overlap").collect()}
    assert rates["a"]["a"] == rates["a"]["b"] == 100.0


def test_reference(spark):
    own = domains(spark, {"same": A, "far": FAR, "off": [(s + 80_000, e + 80_000) for s, e in A]})
    ref = domains(spark, {"r": A}).drop("algorithm")
    out = {(r["algorithm"], r["tol"]): r for r in C.reference_scores(own, ref, keys=keys(spark, "same", "far", "off", "none")).collect()}
    same = out["same", 1]
    assert (same["recall"], same["precision"], same["jaccard"]) == (1, 1, 1) and same["f1"] == pytest.approx(1)
    assert out["far", 1]["recall"] == out["none", 1]["recall"] == out["none", 1]["precision"] == 0
    assert out["off", 1]["recall"] <= out["off", 2]["recall"] == 1
    missing = C.reference_scores(own, ref.limit(0)).filter("algorithm = 'same' and tol = 1").first()
    assert missing["recall"] is None and missing["f1"] is None and missing["jaccard"] is None
    assert "tol2bin_f1" in C.reference_table(own, ref).columns


def test_sizes_are_known():
    assert len(schema.HG19) == 23 and schema.HG19["chr1"] == 249_250_621


@pytest.mark.parametrize("bins", [0, 1, 3])
def test_near_is_the_band_join(spark, bins):
    rng = random.Random(bins)
    a, b = ({(c, rng.randrange(100_000)) for c in ("x", "y") for _ in range(100)} for _ in range(2))
    left, right = (spark.createDataFrame([(c, 100, p) for c, p in s], "chrom string, resolution int, pos long") for s in (a, b))
    wanted = sorted((c, p) for c, p in a if any(c == d and abs(p - q) <= 100 * bins for d, q in b))
    assert sorted((r["chrom"], r["pos"]) for r in near(left, right, schema.KEY, bins).collect()) == wanted
    assert sorted((r["chrom"], r["pos"]) for r in near(left, right, schema.KEY, bins, "left_anti").collect()) == sorted(a - set(wanted))


def test_near_joins_on_buckets(spark, capsys):
    left = spark.createDataFrame([("x", 100, 5)], "chrom string, resolution int, pos long")
    near(left, left, schema.KEY).explain("formatted")
    plan = capsys.readouterr().out
    assert "_bucket" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_overlaps_is_the_overlap_join(spark):
    rng = random.Random(5)
    some = lambda n, most: [("x", s, s + rng.randint(0, most)) for s in (rng.randrange(5000) for _ in range(n))]
    windows, peaks = some(60, 300), some(80, 900)
    w = spark.createDataFrame([("w", *r) for r in windows], "name string, chrom string, start long, end long")
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(peaks)], "peak_id long, chrom string, start long, end long")
    wanted = sorted(i for i, (_, s, e) in enumerate(peaks) if any(s < b and e > a for _, a, b in windows))
    for width in (100, 1000):
        assert sorted(r["peak_id"] for r in overlaps(w, p, width, ["name"]).collect()) == wanted


def test_reference_counts_repeats_when_asked(spark):
    own = domains(spark, {"a": [*A[:2], A[0], *FAR, *FAR], "b": FAR})
    ref = domains(spark, {"r": [A[0], A[0], A[1], A[3]]}).drop("algorithm")
    sets, rows = ({r["algorithm"]: r["jaccard"] for r in C.reference_scores(own, ref, (1,), repeats=x).collect()} for x in (False, True))
    assert sets == {"a": pytest.approx(2 / 4), "b": 0.0}
    # Two times two pairs of the first, one of the second, two rows without: 5 of 7 joined rows, and 4 of the reference.
    assert rows == {"a": pytest.approx(5 / (7 + 4 - 5)), "b": 0.0}
