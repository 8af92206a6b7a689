"""Callers that cut the axis at local minima of a signal, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from . import signals as S

# --- block contrast: windows compared by the ratio of contacts inside and between domains ---


def score_minima(c: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(chrom, resolution, w, bin): strict minima of the bin score (null as 0) under its mean less a standard deviation."""
    own = Window.partitionBy(*KEY, "w")
    marked = S.bin_scores(c, windows).withColumn("_cut", F.round(F.avg("x").over(own) - F.stddev_pop("x").over(own), S.DIGITS)).withColumn("_known", F.count("x").over(own))
    zeros = marked.withColumn("_x", F.col("x")).withColumn("x", F.coalesce("x", F.lit(0.0)))
    return S.strict_minima(zeros, 1, keys=[*KEY, "w"]).filter((F.col("_known") >= 3) & (F.col("_x") < F.col("_cut"))).select(*KEY, "w", "bin")


def contrast(c: DataFrame, domains: DataFrame, sampled: int = 10) -> DataFrame:
    """(chrom, resolution, w, ratio): mean over domains of their mean inner contact, over that of blocks between ``sampled`` domains and all others.

    Domains of one key and window do not overlap. Empty cells count as zeros; sampled domains are the first by a hash of their start.
    """
    key = [*KEY, "w"]
    n = S.n_bins(c)
    d = domains.join(n, KEY)
    for side in ("start", "end"):
        d = d.withColumn(f"_{side}", F.least(F.floor(F.col(side) / F.col("resolution")), F.col("n") - 1))
    d = d.filter("_end > _start").withColumn("len", F.col("_end") - F.col("_start")).withColumn("sampled", F.row_number().over(Window.partitionBy(*key).orderBy(F.md5(F.col("start").cast("string")), "start")) <= sampled)
    each = d.select(*key, F.col("_start").alias("dom"), F.col("_end").alias("past"), "len", "sampled").persist()
    d = each.select(*key, "dom", F.explode(F.sequence(F.col("dom"), F.col("past") - 1)).alias("bin"))
    di = d.select(*key, F.col("bin").alias("i"), F.col("dom").alias("a"))
    dj = d.select(*key, F.col("bin").alias("j"), F.col("dom").alias("b"))
    blocks = c.join(di, [*KEY, "i"]).join(dj, [*key, "j"]).groupBy(*key, "a", "b").agg(F.sum(F.when((F.col("a") == F.col("b")) & (F.col("i") < F.col("j")), 2 * F.col("v")).otherwise(F.col("v"))).alias("s")).persist()
    inner = each.join(blocks.filter("a = b").select(*key, F.col("a").alias("dom"), "s"), [*key, "dom"], "left").groupBy(*key).agg(F.avg(F.coalesce("s", F.lit(0.0)) / (F.col("len") * F.col("len"))).alias("inside"))
    both = blocks.filter("a <> b").unionByName(blocks.filter("a <> b").select(*key, F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    left = each.filter("sampled").select(*key, F.col("dom").alias("a"), F.col("len").alias("len_a"))
    right = each.select(*key, F.col("dom").alias("b"), F.col("len").alias("len_b"))
    between = left.join(both, [*key, "a"]).join(right, [*key, "b"]).groupBy(*key).agg(F.sum(F.col("s") / (F.col("len_a") * F.col("len_b"))).alias("_sum"))
    pairs = each.groupBy(*key).agg(F.sum(F.col("sampled").cast("int")).alias("_k"), F.count(F.lit(1)).alias("_n"))
    mean = F.when(F.col("_n") > 1, F.coalesce("_sum", F.lit(0.0)) / (F.col("_k") * (F.col("_n") - 1))).otherwise(1e-9)
    return inner.join(pairs, key).join(between, key, "left").select(*key, F.round(F.col("inside") / (mean + 1e-9), 6).alias("ratio"))


def block_contrast_domains(c: DataFrame, windows: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """For each chromosome the domains of the window with the best contrast; the first of equals."""
    tried = F.explode(F.array(*map(F.lit, windows))).alias("w")
    each = S.domains_between(score_minima(c, windows), S.n_bins(c).select("*", tried), "n - 1", keys=[*KEY, "w"]).persist()  # read by several branches below
    place = F.array_position(F.array(*map(F.lit, windows)), F.col("w"))
    best = Window.partitionBy(*KEY).orderBy(F.desc("ratio"), "place")
    chosen = contrast(c, each).withColumn("place", place).withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*KEY, "w")
    return each.join(chosen, [*KEY, "w"]).select(*KEY, "start", "end")


# --- insulation: spaced minima, with a second and third try ---


def spaced(candidates: Column, least: int) -> Column:
    """Bins kept of an array of (bin, x) in order: one too close to the last one kept replaces it if deeper."""
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(None).cast("double").alias("depth"), F.array().cast("array<long>").alias("kept"))

    def step(a, p):
        far = p["bin"] - a["last"] >= least
        deeper = a["depth"].isNotNull() & (p["x"] < a["depth"])
        added = F.struct(p["bin"].alias("last"), p["x"].alias("depth"), F.concat(a["kept"], F.array(p["bin"])).alias("kept"))
        moved = F.struct(p["bin"].alias("last"), p["x"].alias("depth"), F.concat(F.slice(a["kept"], F.lit(1), F.size(a["kept"]) - 1), F.array(p["bin"])).alias("kept"))
        return F.when(far, added).when(deeper, moved).otherwise(a)

    return F.aggregate(candidates, start, step, lambda a: a["kept"])


def spaced_minima(signal: DataFrame, sigma: float, depth: float, least: int) -> DataFrame:
    """(chrom, resolution, kept): spaced minima of the smoothed signal at or under mean less ``depth`` deviations."""
    own = Window.partitionBy(*KEY)
    soft = S.smooth(signal, sigma)
    marked = soft.withColumn("_cut", F.round(F.avg("x").over(own) - F.lit(depth) * F.stddev_pop("x").over(own), S.DIGITS))
    low = S.strict_minima(marked, 1).filter(F.col("x") <= F.col("_cut"))
    lists = low.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("bin", "x"))).alias("c"))  # bins of one chromosome at most
    found = spine_of(signal).join(lists, KEY, "left").select(*KEY, F.coalesce("c", F.array().cast("array<struct<bin:bigint,x:double>>")).alias("c"))
    return found.select(*KEY, spaced(F.col("c"), least).alias("kept"))


def spine_of(signal: DataFrame) -> DataFrame:
    return signal.select(*KEY, "n").distinct()


def insulation_domains(c: DataFrame, window: int = 5, sigma: float = 1.5, depth: float = 0.2, least: int = 4, few: int = 10, many: int = 200) -> DataFrame:
    """Domains between spaced insulation minima. Under ``few`` a gentler cut is taken instead, over ``many`` a harder one.

    Chromosomes of fewer than 10 bins give nothing.
    """
    signal = S.insulation(c, window).filter("n >= 10")
    first = spaced_minima(signal, sigma, depth, least)
    gentle = spaced_minima(signal, max(0.5, sigma - 0.5), depth * 0.3, least).withColumnRenamed("kept", "gentle")
    hard = spaced_minima(signal, sigma + 1.0, depth * 1.5, least).withColumnRenamed("kept", "hard")
    kept = F.when(F.size("kept") < few, F.col("gentle")).otherwise(F.col("kept"))
    chosen = first.join(gentle, KEY).join(hard, KEY).withColumn("kept", kept).withColumn("kept", F.when(F.size("kept") > many, F.col("hard")).otherwise(F.col("kept")))
    return S.domains_between(chosen.select(*KEY, F.explode("kept").alias("bin")), spine_of(signal))


# --- flank means ---


def flank_domains(c: DataFrame, least: int = 3, sigma: float = 2.0, most: int = 10) -> DataFrame:
    """Domains of at least ``least`` bins between minima of the smoothed flank mean, strict within half its window."""
    signal = S.smooth(S.flank_mean(c, most), sigma)
    reach = F.greatest(F.lit(1), F.expr(f"least({most}, n div 4) div 2"))
    return S.domains_between(S.strict_minima(signal, reach, max(1, most // 2)).select(*KEY, "bin"), S.n_bins(c), least=least)


# --- sign changes of the directionality ---


def crossing_domains(directed: DataFrame, least: int = 2, sigma: float = 2.0, few: int = 3) -> DataFrame:
    """Domains between falls of the smoothed signal under zero; fewer than ``few`` give way to an even division."""
    soft = S.smooth(directed, sigma)
    before = F.lag("x").over(Window.partitionBy(*KEY).orderBy("bin"))
    marks = soft.withColumn("_p", before).filter("_p >= 0 and x < 0").select(*KEY, "bin")
    spine = spine_of(directed)
    found = S.domains_between(marks, spine, least=least)
    short = spine.join(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")), KEY, "left").filter(F.coalesce("_n", F.lit(0)) < few)
    step = F.greatest(F.lit(2 * least), F.expr("n div 20")).cast("long")
    even = short.withColumn("_step", step).select(*KEY, "n", "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("_step"))).alias("bin"))
    even = even.select(*KEY, (F.col("bin") * F.col("resolution")).alias("start"), (F.least(F.col("bin") + F.col("_step"), F.col("n")) * F.col("resolution")).alias("end"))
    return found.join(short.select(*KEY), KEY, "left_anti").unionByName(even)


def islands(states: DataFrame) -> DataFrame:
    """(chrom, resolution, island, state, first, last): runs of equal states along the bins."""
    own = Window.partitionBy(*KEY).orderBy("bin")
    marked = states.withColumn("_new", F.when(F.col("state") == F.lag("state").over(own), 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*KEY, "island", "state").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))


def pattern_domains(runs: DataFrame, least: int) -> DataFrame:
    """(chrom, resolution, s, e): from a run of state 2 through the next run of state 0, which also ends the search for its partner."""
    own = Window.partitionBy(*KEY).orderBy("island")
    ahead = own.rowsBetween(1, Window.unboundedFollowing)
    zero = F.when(F.col("state") == 0, F.col("island"))
    to = runs.withColumn("_to", F.first(zero, ignorenulls=True).over(ahead)).withColumn("_end", F.first(F.when(F.col("state") == 0, F.col("last")), ignorenulls=True).over(ahead))
    first = to.filter("state = 2 and _to is not null").withColumn("_n", F.row_number().over(Window.partitionBy(*KEY, "_to").orderBy("island"))).filter("_n = 1")
    return first.filter(F.col("_end") - F.col("first") + 1 >= least).select(*KEY, F.col("first").alias("s"), (F.col("_end") + 1).alias("e"))


def transition_domains(runs: DataFrame, spine: DataFrame, least: int) -> DataFrame:
    """(chrom, resolution, s, e) between changes of state from 2 to 0, at once or over one run of 1."""
    own = Window.partitionBy(*KEY).orderBy("island")
    one, two = F.lag("state", 1).over(own), F.lag("state", 2).over(own)
    marks = runs.withColumn("_m", (F.col("state") == 0) & ((one == 2) | ((one == 1) & (two == 2)))).filter("_m").select(*KEY, F.col("first").alias("bin"))
    found = S.domains_between(marks, spine, least=least)
    return found.select(*KEY, (F.col("start") / F.col("resolution")).cast("long").alias("s"), (F.col("end") / F.col("resolution")).cast("long").alias("e"))
