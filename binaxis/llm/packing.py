"""Hierarchical multi-length packing of token ids into windows of several context sizes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents
from .tokens import CHUNK_ROWS, STRETCH, cuts, encoder, tokenizer_path

#: Context sizes, longest first. All are powers of two.
TIERS = (4096, 2048, 1024, 512)
#: Ids that wait in a task before they are packed, and ids per step group.
WAITING_IDS, STEP_IDS = 1 << 22, 64 * 4096

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class Pool:
    """Pieces by length; a bit for each length that is there, so that finding one costs the same however many wait."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.by: dict[int, list[tuple[int, int, int]]] = {}
        self.bits = 0
        for doc, at, n in sorted(pieces):
            self.add(doc, at, n)

    def __bool__(self) -> bool:
        return self.bits > 0

    def add(self, doc: int, at: int, n: int) -> None:
        self.by.setdefault(n, []).append((doc, at, n))
        self.bits |= 1 << n

    def take(self, n: int) -> tuple[int, int, int]:
        own = self.by[n]
        piece = own.pop()
        if not own:
            self.bits ^= 1 << n
        return piece

    def longest(self, most: int) -> int:
        """The greatest length of at most ``most``; 0 if there is none."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1


class Packer:
    """Packs pieces (document number, first id, length) into windows; holds a bounded number of ids.

    A window is a list of pieces that fill it exactly. ``tiers`` are the context sizes.
    """

    def __init__(self, tiers=TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.rest: list[tuple[int, int, int]] = []
        self.waiting = 0

    def add(self, doc: int, n: int) -> Iterator[tuple[int, list]]:
        """Whole longest windows of a document come out at once; the rest of it waits."""
        top, at = self.tiers[0], 0
        while n - at >= top:
            yield top, [(doc, at, top)]
            at += top
        if n > at:
            self.rest.append((doc, at, n - at))
            self.waiting += n - at

    def flush(self, last: bool) -> Iterator[tuple[int, list]]:
        """Pack what waits, tier by tier from the longest.

        A piece goes to the shortest tier that holds it and opens a window there. The gap is filled
        with the longest waiting shorter pieces that fit; where none fits, the shortest is cut. Windows
        that can't be filled wait for the next flush; in the last one they are cut into powers of two.
        """
        pool = Pool(self.rest)
        self.rest, self.waiting = [], 0
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0)):
            while pool.longest(tier) > shorter:
                doc, at, n = pool.take(pool.longest(tier))
                window, gap = [(doc, at, n)], tier - n
                while gap and pool:
                    doc, at, n = pool.take(pool.longest(gap) or pool.shortest())
                    take = min(n, gap)
                    window.append((doc, at, take))
                    gap -= take
                    if n > take:
                        pool.add(doc, at + take, n - take)
                if gap:
                    self.rest += window
                else:
                    yield tier, window
        self.waiting = sum(n for *_, n in self.rest)
        if last and self.rest:
            yield from self._cut_up()

    def _cut_up(self) -> Iterator[tuple[int, list]]:
        pieces, left = self.rest[::-1], self.waiting
        self.rest, self.waiting = [], 0
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, at, n = pieces.pop()
                take = min(n, gap)
                window.append((doc, at, take))
                gap -= take
                if n > take:
                    pieces.append((doc, at + take, n - take))
            left -= size
            yield size, window


def step_groups(sizes: list[int], step_ids: int) -> list[int]:
    """A group for each window: windows of each size are dealt, longest first, to the lightest group."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_ids)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (load + sizes[i], g))
    return out


def _pack(path: str, tiers, waiting_ids: int, step_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        encode, packer = encoder(path), Packer(tiers)
        held: dict[int, list] = {}  # document number -> doc_id, its ids, ids not yet placed
        dealt = sequences = steps = 0

        def out(windows: list[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            groups = step_groups([w for w, _ in windows], step_ids)
            rows: list[tuple] = []
            size = 0
            for (window, pieces), group in zip(windows, groups):
                offset = 0
                for doc, at, n in pieces:
                    doc_id, ids, _ = held[doc]
                    raw = ids[at : at + n].astype("<u4").tobytes()
                    rows.append((doc_id, at, n, raw, len(ids), base + sequences, offset, window, base + steps + group))
                    offset += n
                    size += len(raw)
                    held[doc][2] -= n
                    if not held[doc][2]:
                        del held[doc]
                sequences += 1
                if size > 1 << 22 or len(rows) > 5000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
            steps += max(groups, default=-1) + 1

        ready: list[tuple[int, list]] = []
        for batch in batches:
            for lo, hi in cuts(batch.column(1), STRETCH, CHUNK_ROWS):
                flat, ends = encode.encode(batch.column(1).slice(lo, hi - lo))
                for doc_id, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), np.split(flat, ends[:-1])):
                    held[dealt] = [doc_id, ids, len(ids)]
                    ready += packer.add(dealt, len(ids))
                    dealt += 1
                if packer.waiting + sum(w for w, _ in ready) > waiting_ids:
                    ready += packer.flush(last=False)
                    yield from out(ready)
                    ready = []
                    for own in held.values():  # few; else they would keep the ids of their whole chunks
                        own[1] = own[1].copy()
        ready += packer.flush(last=True)
        yield from out(ready)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def pack(docs: DataFrame, tokenizer: str | None = None, tiers=TIERS, waiting_ids: int = WAITING_IDS, step_ids: int = STEP_IDS) -> DataFrame:
    """Pack the token ids of all documents; one row per piece, with its ids (little-endian, 32 bits).

    Each task packs the documents of its own input partition, so nothing shuffles and a lost task
    is repeated alone; it holds about ``waiting_ids`` ids besides the longest document. Every window is
    filled exactly: a whole tier, or, for the last ids of a task, a smaller power of two. So nothing is padded.
    ``step_group`` gathers windows of about ``step_ids`` ids in all, with even shares of the tiers.

    A null or empty text gives one piece, the end id; a very long one is encoded in stretches, and its whole longest windows come out as
    they are. Of equal lengths the last document goes first. Rows that repeat a doc_id are packed
    each for itself; a null doc_id stays null. An empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    return documents(docs).mapInArrow(_pack(path, tuple(tiers), waiting_ids, step_ids), SCHEMA)
