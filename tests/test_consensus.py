"""Boundaries, clusters and consensus: cases by hand and a random model."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binaxis import schema
from binaxis.operators import boundaries as B


def domains(spark, lists: dict, resolution=25000, chrom="chr17"):
    return spark.createDataFrame([(a, chrom, resolution, s, e) for a, ds in lists.items() for s, e in ds], schema.DOMAINS)


THREE = [(0, 500_000), (500_000, 1_000_000), (1_000_000, 1_500_000)]


def test_contiguous_domains(spark):
    out = [r["pos"] for r in B.boundaries(domains(spark, {"a": [(0, 100_000), (100_000, 300_000), (300_000, 600_000), (600_000, 1_000_000)]})).orderBy("pos").collect()]
    assert out == [0, 100_000, 300_000, 600_000, 1_000_000]


@pytest.mark.parametrize("positions, wanted", [([0, 100_000, 200_000], 3), ([0, 10_000, 20_000], 1), ([0, 20_000, 300_000], 2), ([50_000], 1), ([], 0)])
def test_clusters_by_hand(positions, wanted):
    assert len(set(B.running_median_clusters(positions, 25_000))) == wanted


def test_halves_snap_to_the_even_bin(spark):
    out = B.snapped(domains(spark, {"a": [(12_500, 37_500), (62_500, 87_499)]}))
    assert sorted(r["pos"] for r in out.collect()) == [0, 50_000, 75_000]


def test_equal_algorithms(spark):
    found = B.consensus(domains(spark, {f"a{i}": THREE for i in range(4)})).collect()
    assert len(found) == 4 and all(r["support"] == 4 and r["color"] == "#00C800" for r in found)
    strong = B.consensus(domains(spark, {"a": THREE, "b": THREE, "c": THREE, "d": [(0, 9_000_000)]}), min_support=4).collect()
    assert [(r["position"], r["support"]) for r in strong] == [(0, 4)]


def test_more_support_than_colours(spark):
    five = domains(spark, {f"a{i}": [(0, 500_000)] for i in range(5)})
    assert {r["color"] for r in B.consensus(five).collect()} == {""}
    assert {r["color"] for r in B.consensus(five, saturate=True).collect()} == {"#00C800"}


def test_nothing_in_common(spark):
    apart = domains(spark, {"a": [(0, 500_000)], "b": [(10_000_000, 15_000_000)]})
    assert B.consensus(apart).count() == 0
    assert B.consensus(domains(spark, {}).limit(0)).count() == 0
    one = domains(spark, {"a": [(0, 500_000)]})
    assert B.consensus(one, min_support=1, least_algorithms=2).count() == 0


def test_boundaries_within_tolerance_meet(spark):
    near = domains(spark, {"a": [(0, 500_000)], "b": [(0, 530_000)]}, 50_000)
    assert {r["support"] for r in B.consensus(near, min_support=2).collect()} == {2}


def test_bed6(spark):
    row = B.consensus_bed6(B.consensus(domains(spark, {"a": THREE, "b": THREE}))).orderBy("start").first()
    assert tuple(row) == ("chr17", 0, 25_000, "consensus_support2", 2, ".")


def test_bin_support(spark):
    out = {r["bin"]: r["support"] for r in B.bin_support(domains(spark, {"a": [(0, 75_000)], "b": [(25_000, 100_000)]})).collect()}
    assert out == {1: 2, 2: 2}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), max_size=40))
def test_closed_form_is_the_running_median(bins):
    """Consecutive bins in pairs, run by run."""
    positions, pairs, number = sorted(b * 10 for b in bins), [], -1
    for k, p in enumerate(positions):
        fresh = k == 0 or p - positions[k - 1] > 10
        run = 0 if fresh else run + 1  # noqa: F821
        number += run % 2 == 0
        pairs.append(number)
    assert B.running_median_clusters(positions, 10) == pairs


def test_plans_agree(spark):
    rng = random.Random(0)
    rows = [("a", c, 10, b * 10, b * 10) for c in ("x", "y") for b in rng.sample(range(300), 120)]
    pos = B.boundaries(spark.createDataFrame(rows, schema.DOMAINS), *schema.KEY)
    groups = []
    for on_grid in (True, False):
        out: dict = {}
        for r in B.clusters(pos, 1, on_grid).collect():
            out.setdefault((r["chrom"], r["cluster"]), set()).add(r["pos"])
        groups.append(sorted((c, sorted(p)) for (c, _), p in out.items()))
    assert groups[0] == groups[1]
