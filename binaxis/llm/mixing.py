"""Mixing sources to target weights: blocks of words, drawn per output shard, mapped through index permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_tasks, n_words, row_key, whole_row

#: Weights of the sources in code point order, over and over, and the most often a word is taken.
WEIGHTS, MOST_REPEATS = (1, 2, 3), 3
#: Words a block may hold (a source whose target is small takes shorter ones), and blocks that a target should have at least.
BLOCK_WORDS, BLOCKS_LEAST = (16, 4096), 200
#: Sources that a mix may have.
MOST_SOURCES = 100_000
#: Blocks an output shard is made for, and the most rows of the table of draws.
SHARD_BLOCKS, MOST_DRAWS = 4096, 200_000


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    size: int
    target: float
    words: int  # of a block
    blocks: int
    quota: int  # blocks the mix takes


def share_out(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the sizes' sum by weight; a share stops at ``most`` times its size and the others take up the excess."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        by = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if by * weights[i] > most * sizes[i]}
        for i in open_:
            out[i] = float(most * sizes[i]) if i in over else by * weights[i]
        if not over:
            break
        open_ -= over
    return out


def _length(target: float) -> int:
    """The power of two that cuts a target into BLOCKS_LEAST blocks or more; 1 for a target below that."""
    return 1 << max(0, int(target / BLOCKS_LEAST).bit_length() - 1)


def plan_sources(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST_REPEATS) -> list[Source]:
    """The sources in code point order, null last, with targets, block lengths and quotas.

    The smallest target sets the length of all blocks within BLOCK_WORDS; a source whose own target is too small for it takes
    shorter ones, of one word at least. A quota counts blocks of the mean length, so whole turns take a source exactly.
    """
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    targets = share_out([sizes[n] for n in names], [weights[i % len(weights)] for i in range(len(names))], most)
    common = min(BLOCK_WORDS[1], max(BLOCK_WORDS[0], _length(min((t for t in targets if t > 0), default=1.0))))
    out = []
    for i, (n, t) in enumerate(zip(names, targets)):
        words = min(common, _length(t))
        blocks = -(-sizes[n] // words)
        out.append(Source(i, n, sizes[n], t, words, blocks, min(most * blocks, round(t * blocks / sizes[n])) if blocks else 0))
    return out


def draw_shards(quotas: list[int], seed: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): multinomial counts per output shard, in proportion to what is left of each quota.

    A source's slots run on from shard to shard, so the shards together take each quota exactly.
    """
    rng, left, first = np.random.default_rng(seed), np.array(quotas, np.int64), np.zeros(len(quotas), np.int64)
    total = int(left.sum())
    if not total:
        return
    shards = max(1, min(math.ceil(total / SHARD_BLOCKS), MOST_DRAWS // len(quotas)))
    for shard in range(shards):
        room = int(left.sum()) - total * (shards - 1 - shard) // shards
        counts = np.zeros(len(quotas), np.int64)
        while room:
            open_ = left - counts
            more = np.minimum(rng.multinomial(room, open_ / open_.sum()), open_)
            counts += more
            room -= int(more.sum())
        for s in np.flatnonzero(counts).tolist():
            yield shard, s, int(first[s]), int(counts[s])
        first += counts
        left -= counts


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1: a Feistel network over the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out, todo = np.uint64((1 << half) - 1), index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            x = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x2545F4914F6CDD1D + turn * 0xD1342543DE82EF95) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _slots(blocks: list[int], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                for lo in range(first, first + n, 1 << 16):
                    slot = np.arange(lo, min(first + n, lo + (1 << 16)))
                    at = permuted(slot % blocks[s], blocks[s], seed + s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard)), pa.array(np.full(len(slot), s, np.int32)), pa.array(slot), pa.array(at)], ["shard", "source_no", "slot", "block"])

    return run


@dataclass
class Mix:
    """``sources``, ``taken_blocks`` (shard, source_no, slot, block) and ``placed`` rows."""

    sources: list[Source]
    taken_blocks: DataFrame
    placed: DataFrame

    def source_table(self) -> DataFrame:
        rows = [(s.number, s.name, s.size, s.target, s.words) for s in self.sources]
        return self.placed.sparkSession.createDataFrame(rows, "source_no int, source_name string, source_size long, target double, block_words int")

    def pieces(self) -> DataFrame:
        """(source_no, place, block, block_words, words, times): the part of each placed row in each block that the mix takes."""
        b = F.col("block_words")
        sized = self.placed.filter("size > 0").join(F.broadcast(self.source_table().select("source_no", "block_words")), "source_no")
        spans = sized.select("source_no", "place", "size", "block_words", F.explode(F.sequence(F.expr("place div block_words"), F.expr("(place + size - 1) div block_words"))).alias("block"))
        words = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("place"), F.col("block") * b)
        times = self.taken_blocks.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        return spans.join(times, ["source_no", "block"]).select("source_no", "place", "block", "block_words", words.alias("words"), "times")


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row's first word in the stream of its source's words, in doc_id order.

    Rows are dealt by ranges of (source, doc_id), so a source with most rows is spread over many tasks;
    running sums inside a range start from the sums of the ranges before it, one small row for each range and source.
    """
    spark = sized.sparkSession
    numbered = sized.join(sources.select("source_no", "source_name"), sized["source"].eqNullSafe(F.col("source_name"))).drop("source", "source_name")
    tasks = n_tasks(spark, sized.count(), 1 << 20)
    dealt = cut(numbered.repartitionByRange(tasks, "source_no", "doc_id", "row_key").withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source_no", "part").agg(F.sum("size").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0)))
    inside = Window.partitionBy("source_no", "part").orderBy("doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source_no", "part"]).select("doc_id", "row_key", "source_no", "size", (F.col("base") + F.col("inside")).alias("place"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = 17) -> Mix:
    """Plan a mix of all words of ``docs`` whose sources near their targets.

    The sources' totals are collected to the driver: a row for each source, MOST_SOURCES at most (more are an error). A block is the next so many words of a source's stream; its
    length follows the smallest target, and is less in sources too small for it. Every word lies in one block, and a source's slots visit each
    of its blocks once before any again, so no word is taken more than ``most`` times.

    A null source is a source of its own, last in order. A null text has size 0 and takes nothing.
    Rows that repeat a doc_id are placed each for itself. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), row_key(docs).alias("row_key")), "mix-sizes")
    grouped = sized.groupBy("source").agg(F.sum("size").alias("size"))
    if (n := grouped.count()) > MOST_SOURCES:
        raise ValueError(f"{n} sources; a mix plans at most {MOST_SOURCES} on the driver")
    totals = {r["source"]: r["size"] for r in grouped.collect()}
    sources = plan_sources(totals, weights, most)
    draws = list(draw_shards([s.quota for s in sources], seed))
    drawn = spark.createDataFrame(draws, "shard long, source_no int, first long, slots long")
    drawn = drawn.repartition(n_tasks(spark, len(draws), 1000)) if draws else drawn
    taken = drawn.mapInArrow(_slots([s.blocks for s in sources], seed), "shard long, source_no int, slot long, block long")
    out = Mix(sources, taken, sized.limit(0))
    out.placed = cut(_placed(sized, out.source_table()), "mix-places")
    return out


def mix_report(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``; a null, empty or blank text has size 0 and takes 0. See ``mix``."""
    m = mix(docs, weights, most, seed)
    taken = m.pieces().groupBy("source_no", "place").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    sized = m.placed.filter("size > 0").join(taken, ["source_no", "place"], "left").select("doc_id", "source_no", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    empty = m.placed.filter("size = 0").select("doc_id", "source_no", "size", F.lit(0).cast("long").alias("taken"))
    return sized.unionByName(empty).join(m.source_table(), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def _cut_text(text: str, place: int, block_words: int, times: dict[int, int], turn: int) -> str:
    words = text.encode("utf-8", "surrogatepass").split()
    kept = [w for i, w in enumerate(words) if times.get((place + i) // block_words, 0) >= turn]
    return text if len(kept) == len(words) else b" ".join(kept).decode("utf-8", "surrogatepass")


def _texts(names: list[str]):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, texts = batch.column("row"), batch.column("row").field(at)
            rows, new = [], []

            def flush():
                columns = whole.take(pa.array(rows, pa.int64())).flatten()
                columns[at] = pa.array(new, texts.type)
                return pa.RecordBatch.from_arrays(columns, names)

            size = 0
            for i, (place, block_words, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "block_words", "blocks")))):
                times, text = {b["block"]: b["times"] for b in blocks}, texts[i].as_py()
                for turn in range(1, max(times.values()) + 1):
                    rows.append(i)
                    new.append(_cut_text(text, place, block_words, times, turn))
                    size += len(new[-1])
                    if len(rows) >= 256 or size > 1 << 22:
                        yield flush()
                        rows, new, size = [], [], 0
            if rows:
                yield flush()

    return run


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = 17) -> DataFrame:
    """The mixed corpus: rows of ``docs`` once for each time that words of them are taken, other columns as they are.

    A row's n-th copy holds its words in blocks taken n times or more: the whole text unchanged, or
    the taken words joined by one space. n_chars, if there is such a column, counts the new text's characters.

    A row of which no word is taken does not come: so none of a null, empty or blank text. Rows that repeat a doc_id are
    placed and come each for itself, also where they are equal in all columns. A null source is a source of its own. An empty table gives no rows. Extra columns may have any name.
    """
    m = mix(docs, weights, most, seed)
    plan = m.pieces().groupBy("source_no", "place", "block_words").agg(F.collect_list(F.struct("block", "times")).alias("blocks"))
    placed = m.placed.filter("size > 0").select("row_key", "source_no", "place").join(plan, ["source_no", "place"])
    whole = docs.select(row_key(docs).alias("row_key"), whole_row(docs)[0].alias("row")).groupBy("row_key").agg(F.first("row").alias("row"))
    found = whole.join(placed, "row_key").select("row", "place", "block_words", "blocks")
    out = found.mapInArrow(_texts(docs.columns), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
