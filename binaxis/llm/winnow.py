"""Winnowing: seeds that any long enough match must share, found without comparing documents.

A text is a row of units (words or bytes). A window is ``span`` consecutive units, and its anchor the least
hash of the k-grams in it. Equal windows have equal anchors, so windows need comparing only under
one anchor, and an anchor seen in one place alone needs no comparing. Consecutive windows with one anchor
are a run; a run, with the units that its windows cover, is what travels. Where an anchor is met in very many places (a phrase
that a large part of all texts holds, each time among other words) the different runs under it could outgrow a task:
there each window travels alone, under a key of all its units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import cut, n_tasks

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Windows in a run, and in a block of a very long text, at most.
RUN_WINDOWS, BLOCK_WINDOWS = 1024, 1 << 21
#: Bits of the filter of repeated anchors: per anchor, and at least and most (64 MB).
FILTER_BITS, LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 1 << 19, 1 << 29, 1 << 19
#: Runs that a task gathers before it merges equal ones.
GATHERED = 250_000
#: Runs that are cut into windows at a time.
CUT_RUNS = 2048
#: Stands for a null doc_id, which comes before all others.
NULL_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_tables: list[np.ndarray] = []


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n, held once per worker."""
    if not _tables or len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        _tables[:] = [powers(BASE, size), powers(UNBASE, size)]
    return _tables[0], _tables[1]


class Rolling:
    """Hashes of any stretch of units, from one running sum."""

    def __init__(self, units: np.ndarray):
        up, self.down = tables(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def stretch(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + lengths.astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


@dataclass
class Runs:
    """Runs of a chunk: block, first window (within the chunk's units), windows, anchor."""

    block: np.ndarray
    at: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    many: np.ndarray  # whether the anchor comes from more than one place, so that windows of the run may be equal

    def seen(self) -> np.ndarray:
        """Anchors as often as windows apart from one another have them: twice for such runs."""
        return np.concatenate([self.anchor, self.anchor[self.many]])


def find_runs(rolling: Rolling, lengths: np.ndarray, span: int, k: int) -> Runs | None:
    """Runs in a chunk of blocks laid end to end; no window crosses from one block to the next."""
    grams = rolling.every(k)
    low = np.uint64((1 << 24) - 1)  # a chunk has fewer units; ties go to the first place
    starts = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - span + 1, 0)
    total = int(windows.sum())
    if not total:
        return None
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), span - k + 1)
    block = np.repeat(np.arange(len(lengths)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + starts[block]
    places = (least[at] & low).astype(np.int64)
    anchors = grams[places]
    new = np.append(True, (anchors[1:] != anchors[:-1]) | (block[1:] != block[:-1]))
    first = np.flatnonzero(new)
    inside = np.arange(total) - np.repeat(first, np.diff(np.append(first, total)))
    first = np.flatnonzero(inside % RUN_WINDOWS == 0)
    n = np.diff(np.append(first, total))
    return Runs(block[first], at[first], n, anchors[first], places[first] != places[first + n - 1])


def blocks_of(n_units: int, span: int) -> Iterator[tuple[int, int]]:
    """(first unit, end) of the blocks of a text; they overlap so that each window lies in one."""
    windows = max(n_units - span + 1, 0)
    for lo in range(0, windows, BLOCK_WINDOWS):
        yield lo, min(windows, lo + BLOCK_WINDOWS) + span - 1


# --- the filter of repeated anchors ---


def slots(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (anchors & mask).astype(np.int64), (mix(anchors) & mask).astype(np.int64)


def _places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array((at // CHUNK_BITS).astype(np.int32)), pa.array((at % CHUNK_BITS).astype(np.int32))], ["chunk", "at"])

    return run


def _chunk_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each chunk; rows come chunk by chunk."""
    number, own = None, np.zeros(CHUNK_BITS, bool)

    def out():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    for batch in batches:
        chunk, at = batch.column("chunk").to_numpy(), batch.column("at").to_numpy()
        edges = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
        for lo, hi in zip(edges, np.append(edges[1:], len(chunk)).astype(int)):
            if chunk[lo] != number:
                if number is not None:
                    yield out()
                number = int(chunk[lo])
                own[:] = False
            own[at[lo:hi]] = True
    if number is not None:
        yield out()


def _filter(anchors: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of n anchors, as bytes; its size is a power of two and MOST_BITS bits at most. Chunks of it are filled apart."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, FILTER_BITS * n - 1).bit_length()))
    filled = np.zeros(bits >> 3, np.uint8)
    if n:
        dealt = anchors.mapInArrow(_places(bits), "chunk int, at int").repartition(n_tasks(anchors.sparkSession, n, 1 << 21), "chunk").sortWithinPartitions("chunk")
        for r in dealt.mapInArrow(_chunk_bits, "chunk int, bits binary").toLocalIterator():  # each chunk once: MOST_BITS in all
            lo = r["chunk"] * (CHUNK_BITS >> 3)
            filled[lo : lo + (CHUNK_BITS >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return filled


def repeated_anchors(anchors: DataFrame, hot: int):
    """(broadcast filters of repeated and of hot anchors, places of repeated anchors) from a column ``anchor`` with a row per run.

    Repeated anchors are seen twice or more, hot ones in more than ``hot`` places. Each Bloom filter has MOST_BITS bits
    at most, whatever the input, so it may travel to every worker. On an input too large for it, more runs
    than needed travel, or are cut into windows; none is lost.
    """
    often = cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
    is_hot = F.col("n") > hot
    n, n_hot, places = often.agg(F.count(F.lit(1)), F.count_if(is_hot), F.coalesce(F.sum("n"), F.lit(0))).first()
    filters = _filter(often.select("anchor"), n), _filter(often.filter(is_hot).select("anchor"), n_hot)
    return anchors.sparkSession.sparkContext.broadcast(filters), int(places)


def in_filter(anchors: np.ndarray, filled: np.ndarray) -> np.ndarray:
    a, b = slots(anchors, len(filled) << 3)
    hit = lambda at: (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    out = hit(a)
    out[out] = hit(b[out])
    return out


# --- removal ---


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def spans_of(flags: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Units covered by the flagged windows of a run, as spans from the run's first unit."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > span)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + span).tolist()))


def with_spans(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, text, spans): each row with what is covered in it; ``covered`` has (id, key, first, past).

    Rows that a Bloom filter tells to have nothing covered pass straight through; the others shuffle to meet their spans.
    """
    spans = cut(covered.groupBy("id", "key").agg(F.collect_list(F.struct("first", "past")).alias("spans")), "spans")
    some = Bloom(spans.select(F.xxhash64("id", "key").alias("of")), "of", 1, spans.count())
    keyed = identified(docs, "doc_id").withColumn("maybe", some.may_hold(F.xxhash64("id", "key")))
    alone = keyed.filter("not maybe").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return alone.union(keyed.filter("maybe").join(spans, ["id", "key"], "left").select("doc_id", "text", "spans"))


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """(id, text, key, *more): a null doc_id is the least id; the key tells texts apart."""
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key"), *more)
