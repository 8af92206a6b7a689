"""Gaps between windows against brute force, hierarchies of several penalties, sources and views."""

import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from binaxis import schema
from binaxis.operators import enrichment as N
from binaxis.operators import hierarchy as H
from binaxis.plans import callers, pipeline, render
from binaxis.plans.config import Config
from binaxis.sources import files, plug


@pytest.mark.parametrize("longest", [1, 30, 400])
def test_hit_counts(spark, longest):
    """Peaks of any length, points too, on windows that touch, overlap or leave gaps shorter than a peak."""
    rng = np.random.default_rng(longest)
    peaks = [(i, c, int(a), int(a + rng.integers(0, longest))) for i, (c, a) in enumerate(zip(rng.choice(["x", "y"], 150), rng.integers(0, 2000, 150)))]
    drawn = [(k, c, 50, sorted(int(a) for a in rng.integers(0, 2000, rng.integers(0, 25)))) for k in range(30) for c in ("x", "y", "z")] + [(99, "x", 50, [0, 50, 100, 100, 200])]
    p = spark.createDataFrame(peaks, "peak_id long, chrom string, start long, end long")
    d = spark.createDataFrame(drawn, "k int, chrom string, length long, starts array<long>")
    got = {(r["k"], r["chrom"]): r["n"] for r in N.hit_counts(d, p, 64, ["k", "chrom"]).collect()}
    for k, c, length, starts in drawn:
        wanted = sum(any(a < s + length and b > s for s in starts) for _, own, a, b in peaks if own == c)
        assert got.get((k, c), 0) == wanted


def test_children_in_buckets(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(a + n), int(d)) for a, n, d in zip(rng.integers(0, 400, 200), rng.integers(1, 200, 200), rng.integers(1, 4, 200))]
    df = spark.createDataFrame([("c", *r) for r in rows], "chrom string, start_bin int, end_bin int, depth int")
    got = sorted((r["parent_start"], r["parent_end"], r["parent_depth"], r["start_bin"], r["end_bin"]) for r in H.children(df, ["chrom"], 3).collect())
    assert got == sorted((p[0], p[1], p[2], q[0], q[1]) for p in rows for q in rows if q[2] == p[2] + 1 and q[0] >= p[0] and q[1] <= p[1] and q[1] - q[0] >= 3)


def hierarchies(tmp_path, files_of):
    for name, rows in files_of.items():
        (tmp_path / name).write_text("# rows\n" + "\n".join("\t".join(map(str, r)) for r in rows) + "\nbad\n")
    return str(tmp_path / "*.tad")


def test_penalties_of_hierarchies(spark, tmp_path):
    """400 bins of 25 kb: 8 to 25 domains on target; the first penalty on target wins, a chromosome without hierarchy falls back."""
    even = lambda k, d: [(i * (400 // k) + 1, (i + 1) * (400 // k), d, 1.0, 1.0) for i in range(k)]
    glob = hierarchies(tmp_path, {"chr1_25kb_p0.1.tad": even(2, 1), "chr1_25kb_p0.05.tad": even(2, 1) + even(10, 2), "chr1_25kb_p0.02.tad": even(16, 1), "chr3_25kb_p0.1.tad": [(1, 2, 1, 0, 0)]})
    rows = files.read_hierarchy_tree(spark, glob)
    assert {(r["chrom"], r["resolution"], r["penalty"]) for r in rows.collect()} == {("chr1", 25_000, 0.1), ("chr1", 25_000, 0.05), ("chr1", 25_000, 0.02), ("chr3", 25_000, 0.1)}
    n = spark.createDataFrame([("chr1", 25_000, 400), ("chr2", 25_000, 400), ("chr3", 25_000, 400)], "chrom string, resolution int, n long")
    plain = spark.createDataFrame([(c, 25_000, 0, 10**7) for c in ("chr1", "chr2", "chr3")], schema.CALLED)
    got = H.swept_domains(rows, n, 3, 100, plain).collect()
    own = sorted((r["start"], r["end"]) for r in got if r["chrom"] == "chr1")
    assert own == [(i * 10**6, (i + 1) * 10**6) for i in range(10)]
    assert sorted((r["chrom"], r["start"], r["end"]) for r in got if r["chrom"] != "chr1") == [("chr2", 0, 10**7), ("chr3", 0, 10**7)]


@pytest.fixture(scope="module")
def contacts(spark):
    rows = [(c, 25_000, i * 25_000, j * 25_000, float(10 if i // 10 == j // 10 else 1)) for c in ("chr21", "chr22") for i in range(40) for j in range(i, 40)]
    return spark.createDataFrame(rows, schema.CONTACTS).persist()


def test_hierarchy_caller(spark, contacts, tmp_path):
    glob = hierarchies(tmp_path, {"chr21_25kb_p0.1.tad": [(i * 8 + 1, (i + 1) * 8, 1, 1.0, 1.0) for i in range(5)]})
    sizes = pipeline.hg19_sizes(spark)
    own = callers.detect(contacts, sizes, Config(algorithms=("ontad",), hierarchies=glob)).collect()
    plain = callers.detect(contacts, sizes, Config(algorithms=("ontad",))).collect()
    assert sorted((r["start"], r["end"]) for r in own if r["chrom"] == "chr21") == [(i * 200_000, (i + 1) * 200_000) for i in range(5)]
    assert sorted(map(tuple, (r for r in own if r["chrom"] == "chr22"))) == sorted(map(tuple, (r for r in plain if r["chrom"] == "chr22")))


@pytest.mark.parametrize("result", [None, [], [(0, 10), (10, 10), (20, 30)], np.array([[0, 10], [10, 10], [20, 30]]), pd.DataFrame({"start": [0, 10, 20], "end": [10, 10, 30]}), [1, 2]])
def test_results_of_external_callers(result):
    out = callers.normalised(result, "c", 5)
    assert list(out.columns) == ["chrom", "resolution", "start", "end"]
    assert out.values.tolist() == ([] if result is None or len(result) in (0, 2) else [["c", 5, 0, 10], ["c", 5, 20, 30]])


def test_matrix_caller(spark, contacts):
    @callers.register_matrix("halves")
    def halves(matrix, resolution):
        assert (matrix == matrix.T).all()
        return [(0, len(matrix) // 2 * resolution), (len(matrix) // 2 * resolution, len(matrix) * resolution)]

    try:
        got = callers.detect(contacts, pipeline.hg19_sizes(spark), Config(algorithms=("halves",))).collect()
        assert sorted((r["chrom"], r["start"], r["end"]) for r in got) == [(c, a, a + 500_000) for c in ("chr21", "chr22") for a in (0, 500_000)]
    finally:
        del callers.CALLERS["halves"]


def test_limits_by_default():
    assert Config().limits["scktld"][25_000] == [f"chr{k}" for k in range(17, 23)] and "chr1" in Config().limits["scktld"][50_000]


def test_last_of_repeated_pairs(spark, tmp_path):
    (tmp_path / "t").write_text("0\t10\t1\n10\t0\t7\n0\t0\t5\n0\t10\t3\n")
    got = {(r["bin_i"], r["bin_j"]): r["count"] for r in files.read_triples(spark, str(tmp_path / "t"), "c", 10, "last").collect()}
    assert got == {(0, 10): 3.0, (0, 0): 5.0}


def test_dense_in_splits(spark, tmp_path):
    """Rows keep their numbers where a file is read in several splits, with blank lines at the end."""
    m = np.random.default_rng(1).integers(0, 3, (60, 60))
    text = "\n".join("\t".join(map(str, r)) for r in m) + "\n\n"
    (tmp_path / "m.txt").write_text(text)
    with gzip.open(tmp_path / "m.gz", "wt") as f:
        f.write(text)
    wanted = {(i * 10, j * 10): float(m[i, j]) for i in range(60) for j in range(i, 60) if m[i, j]}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        for name in ("m.txt", "m.gz"):
            df = files.read_dense(spark, str(tmp_path / name), "c", 10)
            assert {(r["bin_i"], r["bin_j"]): r["count"] for r in df.collect()} == wanted
        assert spark.read.text(str(tmp_path / "m.txt")).rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_through(spark, contacts, tmp_path):
    calls = []
    reader = lambda: calls.append(1) or contacts
    for _ in range(2):
        got = files.read_through(spark, str(tmp_path / "cache"), [lambda: None, reader])
        assert got.count() == contacts.count()
    assert len(calls) == 1


def test_contact_files_of_a_library(spark, tmp_path):
    module = tmp_path / "own_contact_reader.py"
    module.write_text("def records(path, chrom, resolution, normalization):\n    yield resolution, 0, len(path)\n    yield 0, 0, 2 if normalization == 'NONE' else 3\n")
    spark.sparkContext.addPyFile(str(module))
    spark.dataSource.register(plug.ContactSource)
    df = spark.read.format("contact-file").option("path", "abc").option("reader", "own_contact_reader").option("chroms", "chr1, chr2").option("resolutions", "10,20").load()
    assert df.schema == spark.createDataFrame([], schema.CONTACTS).schema
    assert sorted(map(tuple, df.collect())) == sorted((c, r, 0, b, n) for c in ("chr1", "chr2") for r in (10, 20) for b, n in ((r, 3.0), (0, 2.0)))


def test_views_are_written(spark, contacts, tmp_path):
    contacts.write.parquet(str(tmp_path / "contacts"))
    base = ["--contacts", str(tmp_path / "contacts"), "--out", str(tmp_path / "out"), "--algorithms", "ontad", "coitad", "--skip-stats", "--skip-report"]
    assert pipeline.main([*base, "--only-viz"]) == 1
    assert pipeline.main(base) == 0 and not (tmp_path / "out/views").exists()
    assert pipeline.main([*base, "--only-viz", "--views", "chr21:0-500000", "chr22:250000-750000"]) == 0
    cells = spark.read.parquet(str(tmp_path / "out/views/cells"))
    assert {(r["chrom"], r["lo"], r["hi"]) for r in cells.groupBy("chrom").agg(F.min("bin_i").alias("lo"), F.max("bin_j").alias("hi")).collect()} == {("chr21", 0, 475_000), ("chr22", 250_000, 725_000)}
    assert (tmp_path / "out/views/triangles").exists() and (tmp_path / "out/views/lines").exists()
    with pytest.raises(ValueError):
        render.views(contacts, contacts, contacts, {})
