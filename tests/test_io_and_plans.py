"""Sources, sinks, enrichment, the caller registry, the whole run, the command line, streams and the driver's contract."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from binaxis import schema
from binaxis.functions import scalar
from binaxis.operators import enrichment as N
from binaxis.plans import callers, pipeline, render
from binaxis.plans.config import Config, parse_yaml
from binaxis.sources import files
from binaxis.streaming import contacts as stream


def test_triples(spark, tmp_path):
    (tmp_path / "chr1_25kb.RAWobserved").write_text("0\t25000\t3\n25000\t0\t2\n25000\t25000\t7.5\nbad\tx\t1\n")
    path = str(tmp_path / "chr1_25kb.RAWobserved")
    got = {(r["bin_i"], r["bin_j"]): r["count"] for r in files.read_triples(spark, path, "chr1", 25_000).collect()}
    assert got == {(0, 25_000): 5.0, (25_000, 25_000): 7.5}
    assert {r["count"] for r in files.read_triples(spark, path, "chr1", 25_000, "max").collect()} == {3.0, 7.5}
    tree = files.read_triples_tree(spark, str(tmp_path / "*.RAWobserved")).filter("bin_i is not null")
    assert {(r["chrom"], r["resolution"]) for r in tree.collect()} == {("chr1", 25_000)}
    files.write_triples(files.read_triples(spark, path, "chr1", 25_000), str(tmp_path / "out"))
    assert files.read_triples(spark, str(tmp_path / "out"), "chr1", 25_000).count() == 2


def test_prepared_tables_and_fallbacks(spark, tmp_path):
    one = spark.createDataFrame([("chr1", 10, 0, 10, 1.0)], schema.CONTACTS)
    other = spark.createDataFrame([("chr1", 10, 0, 10, 9.0), ("chr2", 10, 0, 0, 2.0)], schema.CONTACTS)
    path = str(tmp_path / "table")
    files.prepare(one, path)
    assert {r["count"] for r in files.prepare(other, path).collect()} == {1.0, 2.0}
    assert {r["count"] for r in files.prepare(other, path, force=True).collect()} == {9.0, 2.0}
    found = files.first_of(spark, [lambda: files.read_table(spark, str(tmp_path / "none"), schema.CONTACTS), lambda: files.read_table(spark, path, schema.CONTACTS)])
    assert found.count() == 2
    with pytest.raises(FileNotFoundError):
        files.first_of(spark, [lambda: None])
    assert files.read_domains(spark, str(tmp_path / "none")).count() == 0


def test_dense_matrix(spark, tmp_path):
    with gzip.open(tmp_path / "m.gz", "wt") as f:
        f.write("1\t2\t0\n2\t0\t3\n0\t3\t5\n")
    got = {(r["bin_i"], r["bin_j"]): r["count"] for r in files.read_dense(spark, str(tmp_path / "m.gz"), "c", 10).collect()}
    assert got == {(0, 0): 1, (0, 10): 2, (10, 20): 3, (20, 20): 5}
    (tmp_path / "bad.txt").write_text("1\t2\n3\n")
    with pytest.raises(ValueError):
        files.read_dense(spark, str(tmp_path / "bad.txt"), "c", 10)


def test_log_counts(spark):
    c = spark.createDataFrame([("c", 10, 0, 10, 8.0), ("c", 10, 0, 20, 4.0), ("c", 10, 10, 10, 0.0)], schema.CONTACTS)
    assert sorted(r["count"] for r in files.log_counts(c).collect()) == pytest.approx([math.log(4), math.log(8)])
    k = spark.createDataFrame([("c", 0, 2.0), ("c", 1, 4.0), ("c", 2, float("nan"))], "chrom string, bin long, k double")
    assert [r["count"] for r in files.log_counts(c, k).collect()] == pytest.approx([0.0])


def test_intervals(spark, tmp_path):
    (tmp_path / "p.bed").write_text("1\t5\t9\tx\t1\nchr2\t7\t8\ty\t2\n")
    assert {(r["chrom"], r["start"], r["end"]) for r in files.read_bed3(spark, str(tmp_path / "p.bed")).collect()} == {("chr1", 5, 9), ("chr2", 7, 8)}
    (tmp_path / "ref.tsv").write_text("chr1\tx1\tx2\tmore\n17\t0\t100\tz\nchr18\t5\t50\tz\n")
    assert {(r["chrom"], r["start"]) for r in files.read_reference(spark, str(tmp_path / "ref.tsv"), 10).collect()} == {("chr17", 0), ("chr18", 5)}
    assert files.read_reference(spark, str(tmp_path / "ref.tsv"), 10, "chr17").count() == 1
    (tmp_path / "d.txt").write_text("N/A  3 9\n\nc x 9\nc 1\nchr1\t5\t6\textra\n")
    assert {(r["start"], r["end"]) for r in files.read_domain_text(spark, str(tmp_path / "d.txt")).collect()} == {(3, 9), (5, 6)}
    (tmp_path / "h.tad").write_text("# c\n1 10 1 0.5 0.25\n\n1 5 2 0.5\nx 5 2 1 1\n3 7 2 .1 .2\n")
    assert {(r["start_bin"], r["depth"]) for r in files.read_hierarchy_text(spark, str(tmp_path / "h.tad")).collect()} == {(1, 1), (3, 2)}


def test_domain_files(spark, tmp_path):
    d = spark.createDataFrame([("a", "chr1", 10, 0, 50), ("b", "chr2", 10, 10, 20)], schema.DOMAINS)
    files.write_domains(d, str(tmp_path / "d"))
    assert sorted(map(tuple, files.read_domains(spark, str(tmp_path / "d")).select(d.columns).collect())) == sorted(map(tuple, d.collect()))
    files.write_bed(d.select("chrom", "start", "end"), str(tmp_path / "bed"))
    assert files.read_domains_bed(spark, str(tmp_path / "bed"), "x", 10).count() == 2
    assert [r["end"] for r in files.inclusive_text(d).orderBy("chrom").collect()] == [49, 19]
    bed6 = spark.createDataFrame([("chr1", 30, 40, "consensus_support2", 2, ".")], schema.BED6)
    files.write_bed(bed6, str(tmp_path / "b6"))
    assert tuple(files.read_consensus_bed(spark, str(tmp_path / "b6")).first()) == ("chr1", 30, 2)
    assert files.resolution_label(25_000) == "25kb" and files.resolution_label(1500) == "1500bp"


def test_scalars(spark):
    row = spark.createDataFrame([("1", 7, float("nan"), 5.0)], "c string, p long, x double, y double")
    out = row.select(scalar.with_chr(F.col("c")), scalar.without_chr(F.lit("chr1")), scalar.to_bin(F.col("p"), 3), scalar.clean(F.col("x")), scalar.clip(F.col("p"), 0, 5), scalar.midpoint(F.col("p"), F.lit(10)), scalar.log_positive(F.lit(0.0)), scalar.upper_tail(F.lit(1.6448536))).first()
    assert tuple(out)[:7] == ("chr1", "1", 2, 0.0, 5, 8, None) and out[7] == pytest.approx(0.05, abs=1e-6)


@pytest.fixture(scope="module")
def track(spark):
    domains = spark.createDataFrame([("a", "chr1", 100, 1000, 2000), ("a", "chr1", 100, 2000, 4000)], schema.DOMAINS)
    peaks = spark.createDataFrame([(i, "chr1", p, p + 10) for i, p in enumerate([950, 1990, 2005, 3000, 4099, 4101])] + [(9, "chr2", 1000, 1010)], "peak_id long, chrom string, start long, end long")
    sizes = spark.createDataFrame([("chr1", 10_000), ("chr2", 5_000)], "chrom string, size long")
    return domains, peaks, sizes


def test_enrichment(track):
    domains, peaks, sizes = track
    assert N.observed(domains, peaks, 200).first()["observed_count"] == 4
    for exact in (False, True):
        null = N.null_counts(domains, peaks, sizes, 200, 40, exact=exact).collect()
        assert len(null) == 40 and max(r["n"] for r in null) <= 6
        drawn = N.random_windows(domains.limit(1).select("algorithm", "chrom", "resolution", F.lit(3).cast("long").alias("n"), F.lit(200).cast("long").alias("length"), F.lit(10_000).cast("long").alias("size")), 40, exact=exact).collect()
        assert len(drawn) == 120 and all(0 <= r["start"] and r["end"] == r["start"] + 200 <= 10_000 for r in drawn)
    row = N.enrichment(domains, peaks, sizes, 200, 40).first()
    assert row["enrichment_score"] > 1 and row["p_value"] == pytest.approx(0.5 * math.erfc(row["z_score"] / math.sqrt(2)))


def test_exact_draws_are_numpys(track, spark):
    domains, peaks, sizes = track
    n = spark.createDataFrame([("a", "chr1", 100, 3, 200, 10_000)], "algorithm string, chrom string, resolution int, n long, length long, size long")
    got = {}
    for r in N.random_windows(n, 5, 42, exact=True).collect():
        got.setdefault(r["perm"], []).append(r["start"])
    assert all(sorted(got[p]) == sorted(np.random.default_rng(42 + p).integers(0, 9800, size=3).tolist()) for p in range(5))


def test_profile(track):
    domains, peaks, sizes = track
    out = N.profile(domains, peaks, sizes, 1000, 100).orderBy("bin").collect()
    mids, pos = [955, 1995, 2010, 3005, 4104, 4106], [1000, 2000, 4000]
    counts, _ = np.histogram([m - p for p in pos for m in mids if -1000 <= m - p < 1000], bins=np.linspace(-1000, 1000, 21))
    assert [r["n"] for r in out] == counts.tolist()
    assert [r["density"] for r in out] == pytest.approx((counts / (3 * 0.1)).tolist())
    assert out[0]["center"] == -950


def test_validation_rows(track, spark):
    domains, peaks, sizes = track
    consensus = spark.createDataFrame([("chr1", 100, 2000, 2, "x"), ("chr1", 100, 4000, 5, "")], schema.CONSENSUS)
    out = N.validation(domains, consensus, peaks, sizes, 200, 10).collect()
    assert sorted((r["type"], r["support"]) for r in out) == [("algorithm", None), ("consensus", 2)]


# --- plans ---


def test_yaml():
    text = "# c\nresolutions: [10, 20]   # bp\nlimits:\n  a:\n    10: [\"x\",\n         \"y\"]\n  b: null\nname: \"#fff\"\nx: 1.5\nflag: true\n"
    assert parse_yaml(text) == {"resolutions": [10, 20], "limits": {"a": {10: ["x", "y"]}, "b": None}, "name": "#fff", "x": 1.5, "flag": True}
    assert Config.of({"resolutions": [5]}).resolutions == (5,)
    with pytest.raises(ValueError):
        Config.of({"nonsense": 1})


def test_eligible(spark):
    df = spark.createDataFrame([("chr1", 10), ("chr2", 10), ("chr1", 20)], "chrom string, resolution int")
    assert callers.eligible(df, {}).count() == 3
    assert callers.eligible(df, {10: ["chr1"], 20: []}).count() == 2


@pytest.fixture(scope="module")
def contacts(spark):
    rng, rows = np.random.default_rng(0), []
    for chrom in ("chr21", "chr22"):
        for i in range(40):
            for j in range(i, 40):
                rows.append((chrom, 25_000, i * 25_000, j * 25_000, float((10 if i // 10 == j // 10 else 1) + rng.integers(0, 4))))
    return spark.createDataFrame(rows, schema.CONTACTS).persist()


FAST = Config(algorithms=("ontad", "modularity_tad", "scktld"), gammas=(0.1, 0.2), least_windows=10, dimensions=4, permutations=5, hmm_rounds=5, limits={"scktld": {25_000: ["chr22"]}})


def test_whole_run(spark, contacts):
    peaks = spark.createDataFrame([(i, "chr21", i * 30_000, i * 30_000 + 500) for i in range(30)], "peak_id long, chrom string, start long, end long")
    reference = spark.createDataFrame([("chr21", 25_000, k * 250_000, (k + 1) * 250_000) for k in range(4)], schema.CALLED)
    out = pipeline.run(contacts, FAST, peaks, reference)
    names = {(r["algorithm"], r["chrom"]) for r in out.domains.select("algorithm", "chrom").distinct().collect()}
    assert {a for a, _ in names} == set(FAST.algorithms) and ("scktld", "chr21") not in names
    assert out.domains.filter("end <= start").count() == 0 and out.consensus.count() > 0
    assert set(out.statistics) == {"basic", "pairwise_jaccard", "pairwise_overlap", "reference_comparison"}
    page = render.report({"basic": out.statistics["basic"]})
    assert page.count("<tr>") == 7 and "—" in page
    assert set(out.validation.columns) >= {"type", "support", "p_value"}


def test_unknown_caller_and_own_caller(spark, contacts):
    sizes = pipeline.hg19_sizes(spark)
    with pytest.raises(ValueError):
        callers.detect(contacts, sizes, Config(algorithms=("nobody",)))

    @callers.register("whole")
    def whole(c, sizes, cfg):
        return c.groupBy("chrom", "resolution").agg(F.lit(0).alias("start"), ((F.max("j") + 1) * F.col("resolution")).alias("end"))

    try:
        assert callers.detect(contacts, sizes, Config(algorithms=("whole",), chromosomes=("chr21",))).collect()[0]["end"] == 1_000_000
    finally:
        del callers.CALLERS["whole"]


def test_command_line(spark, contacts, tmp_path):
    contacts.write.parquet(str(tmp_path / "contacts"))
    base = ["--contacts", str(tmp_path / "contacts"), "--out", str(tmp_path / "out"), "--algorithms"]
    assert pipeline.main([*base, "nobody"]) == 1
    assert pipeline.main([*base, "ontad", "--resolution", "25000", "--chroms", "chr22", "--skip-stats"]) == 0
    assert {r["algorithm"] for r in files.read_domains(spark, str(tmp_path / "out/domains")).collect()} == {"ontad"}
    assert (tmp_path / "out/report").exists() and (tmp_path / "out/consensus").exists()
    assert pipeline.main([*base, "coitad", "--prep-data"]) == 0 and (tmp_path / "out/contacts").exists()


def test_views(spark, contacts):
    cells = render.heat_cells(contacts, 0, 250_000)
    assert cells.agg(F.max("bin_j")).first()[0] == 225_000 and cells.filter("low > high").count() == 0
    d = spark.createDataFrame([("a", "c", 10, 20, 60)], schema.DOMAINS)
    assert tuple(render.triangles(d, 10, 100).first())[3:] == (1, 5, 3.0)
    k = spark.createDataFrame([("c", 10, 30, 5, ""), ("c", 10, 40, 2, "#FFD700")], schema.CONSENSUS)
    assert {(r["bin"], r["color"]) for r in render.lines(k, 10, 100).collect()} == {(2, "#999999"), (3, "#FFD700")}


def test_streams(spark, tmp_path):
    pairs = spark.createDataFrame([("c", 10, 0, 10, "2024-01-01 00:10:00"), ("c", 10, 10, 0, "2024-01-01 00:20:00"), ("c", 10, 0, 0, "2024-01-01 05:00:00")], "chrom string, resolution int, bin_i long, bin_j long, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    pairs.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("now", stream.running_contacts(source), "update"), ("closed", stream.windowed_contacts(source), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r["bin_i"], r["bin_j"], r["count"]) for r in spark.table("now").collect()} == {(0, 10, 2.0), (0, 0, 1.0)}
    assert {(r["bin_i"], r["bin_j"], r["count"]) for r in spark.table("closed").collect()} == {(0, 10, 2.0)}


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "consensus_tol1" in sql
