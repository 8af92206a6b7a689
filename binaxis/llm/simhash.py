"""SimHash near-dedup: 64-bit fingerprints, linked by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import cut, documents, join_groups, n_tasks, row_key, whole_row
from .components import components
from .tokens import chunks

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Node pairs that a task holds at a time, and pairs of leaves that are compared outright.
HELD_PAIRS, LEAF_PAIRS = 1 << 18, 64


# --- fingerprints ---


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of k words, the text's A-Z lowered; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[lo : lo + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in chunks(batch, rows=512):
                prints = np.array([fingerprint(shingle_hashes(t, k)) if t else 0 for t in texts], np.uint64)
                more = [c.slice(at, len(ids)) for c in batch.columns[2:]]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints.view(np.int64)), *more], ["doc_id", "print", *batch.schema.names[2:]])

    return run


def fingerprints(docs: DataFrame, k: int = SHINGLE, *more: str) -> DataFrame:
    """(doc_id, print, *more): the fingerprint's bits as a signed long; 0 for a null or wordless text."""
    kinds = dict(docs.dtypes)
    return documents(docs, *more).mapInArrow(_fingerprints(k), ", ".join(["doc_id long", "print long", *(f"{c} {kinds[c]}" for c in more)]))


# --- links ---


def block_tables(n: int, budget: int = BUDGET) -> list[tuple[list[tuple[int, int]], int]]:
    """Ways to put some blocks of the bits first: (list of (lowest bit, width) from the top, bits of the key).

    Cut into budget + a blocks, two prints within the budget agree on a whole blocks at least. More
    prints take a larger a, so that the tries under one key stay small: their number of prints is about
    n / 2 ** key bits.
    """
    agree = 1 if n <= 1 << 22 else 2 if n <= 1 << 30 else 3
    blocks, edges = budget + agree, np.linspace(0, 64, budget + agree + 1).round().astype(int)
    spans = [(int(lo), int(hi - lo)) for lo, hi in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(range(blocks), agree):
        first = [spans[i] for i in chosen]
        out.append((first + [spans[i] for i in range(blocks) if i not in chosen], sum(w for _, w in first)))
    return out


def turned(prints: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The bits of each print with the given blocks in the given order from the top."""
    out = np.zeros(len(prints), np.uint64)
    for low, width in spans:
        out = (out << np.uint64(width)) | ((prints >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def trie_pairs(prints: np.ndarray, key_bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of sorted, distinct prints that share the first bits and differ in at most ``budget`` others.

    A trie node is a range of the sorted prints under one prefix. Node pairs go down together, one bit a step;
    a pair whose sides took different bits has spent one of its budget, and is dropped beyond it.
    """
    n = len(prints)
    if n < 2:
        return
    key = prints >> np.uint64(64 - key_bits)
    lo = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    hi = np.append(lo[1:], n)
    roots = hi - lo > 1
    lo, hi = lo[roots], hi[roots]
    todo = [(63 - key_bits, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))] if len(lo) else []
    while todo:
        bit, nodes = todo.pop()
        if nodes.shape[1] > HELD_PAIRS:
            half = nodes.shape[1] // 2
            todo += [(bit, nodes[:, :half]), (bit, nodes[:, half:])]
            continue
        sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = (sizes <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            yield from _leaves(prints, nodes[:, small], sizes[small], budget)
        nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        ones = np.concatenate(([0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        l1, h1, l2, h2, spent = nodes
        m1, m2 = h1 - (ones[h1] - ones[l1]), h2 - (ones[h2] - ones[l2])
        same = l1 == l2  # a node with itself: its two crossed children are one pair
        down = np.concatenate([
            np.stack([l1, m1, l2, m2, spent]),
            np.stack([m1, h1, m2, h2, spent]),
            np.stack([l1, m1, m2, h2, spent + 1]),
            np.stack([m1, h1, l2, m2, spent + 1])[:, ~same],
        ], axis=1)
        keep = (down[4] <= budget) & (down[1] > down[0]) & (down[3] > down[2]) & ~((down[0] == down[2]) & (down[1] - down[0] < 2))
        if keep.any():
            todo.append((bit - 1, down[:, keep]))


def _leaves(prints, nodes, sizes, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    of = np.repeat(np.arange(nodes.shape[1]), sizes)
    k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = (nodes[3] - nodes[2])[of]
    i, j = nodes[0][of] + k // wide, nodes[2][of] + k % wide
    near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
    if near.any():
        yield i[near], j[near]


def forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the sets of i and j; ``parent`` names the smallest member of each set."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _spread(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (spans, bits) in enumerate(tables):
                at = turned(prints, spans)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array((at >> np.uint64(64 - bits)).astype(np.int64)), pa.array(at.view(np.int64))], ["table", "key", "turned"])

    return run


def _join_tries(tables, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("table").to_numpy(zero_copy_only=False), b.column("turned").to_numpy(zero_copy_only=False).view(np.uint64)) for b in batches if b.num_rows]
        if not parts:
            return
        table, prints = (np.concatenate(c) for c in zip(*parts))
        for t, (spans, bits) in enumerate(tables):
            own = np.unique(prints[table == t])
            parent = np.arange(len(own))
            for i, j in trie_pairs(own, bits, budget):
                parent = forest(parent, i, j)
            linked = np.flatnonzero(parent != np.arange(len(own)))
            if len(linked):
                back, at = [], 64
                for low, width in spans:  # where each block went, to put it back
                    at -= width
                    back.append((low, at, width))
                whole = np.zeros(len(own), np.uint64)
                for low, at, width in back:
                    whole |= ((own >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(low)
                yield pa.RecordBatch.from_arrays([pa.array(whole[linked].view(np.int64)), pa.array(whole[parent[linked]].view(np.int64))], ["a", "b"])

    return run


def print_links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links that connect all prints within ``budget`` bits of one another.

    ``prints`` has one column, each print once. Each table of block_tables deals the prints by its key, whose values
    are the roots of the tries; tasks join the tries under their keys, and of the pairs found tell a
    spanning forest, so that a cluster of m prints gives m - 1 links a table and not m * m.
    """
    n = prints.count()
    tables = block_tables(n, budget)
    spread = prints.mapInArrow(_spread(tables), "table int, key long, turned long")
    tasks = n_tasks(prints.sparkSession, n * len(tables), 1 << 19)
    return spread.repartition(tasks, "table", "key").mapInArrow(_join_tries(tables, budget), "a long, b long")


def near_groups(docs: DataFrame, k: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Rows of one fingerprint are one node of the join, whatever their number. component_id is the smallest doc_id of all
    rows reachable over links of at most ``budget`` differing bits.

    A null or wordless text has fingerprint zero and links like any other. Rows that repeat a doc_id
    are rows of their own; null doc_ids count only where a component has no other, whose component_id is then null.
    A text of any length is hashed whole. An empty table gives no rows; other columns are not read.
    """
    marked = cut(fingerprints(docs, k), "prints")
    nodes = marked.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    links = print_links(nodes.select("print"), budget)
    roots = components(links).join(nodes.select(F.col("print").alias("u"), "least"), "u")
    named = cut(roots.groupBy("root").agg(F.min("least").alias("linked_id")).join(roots.select("u", "root"), "root").select(F.col("u").alias("print"), "linked_id"), "near-roots")
    found = nodes.join(named, "print", "left").select("print", "n", F.when(F.col("linked_id").isNull(), F.col("least")).otherwise(F.col("linked_id")).alias("component_id"))
    return join_groups(marked, cut(found, "print-groups"), "print", "n", marked.count()).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, k: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, and of rows with this doc_id that of the least key.

    A row's key is a hash of all its columns, so rows of one doc_id in different components each stay, and of a row that repeats, one.
    Keys alone shuffle to find what goes. Rows that are surely not among those that go, by a Bloom filter of their keys, pass straight through;
    the others shuffle to meet the table of such keys.

    A null doc_id comes after all others; a component of only null doc_ids keeps one row too. A null, empty or wordless text has
    fingerprint zero, so all such rows are one component and one stays. An empty table gives no rows. Extra columns may have any name.
    """
    keyed = docs.select(docs["doc_id"], docs["text"], row_key(docs).alias("key"))
    marked = cut(fingerprints(keyed, k, "key"), "prints")
    nodes = cut(marked.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("n")), "print-nodes")
    roots = components(print_links(nodes.select("print"), budget)).withColumnRenamed("u", "print")
    linked = nodes.join(roots, "print", "left").select("print", "first", "n", "root")
    first = linked.filter("root is not null").groupBy("root").agg(F.min("first").alias("of_all"))
    crowded = linked.filter("n > 1 or root is not null").join(first, "root", "left").select("print", "n", F.coalesce("of_all", "first")["key"].alias("stays"))
    rows = marked.count()
    met = join_groups(marked.select("print", "key"), cut(crowded, "near-groups"), "print", "n", rows)
    touched = cut(met.groupBy("key").agg(F.max(F.col("key") == F.col("stays")).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not kept"), "near-touched")
    goes = Bloom(touched, "key", 1, touched.count())
    whole = docs.select(row_key(docs).alias("key"), whole_row(docs)[0].alias("row"))
    flagged = whole.withColumn("maybe", goes.may_hold(F.col("key")))
    alone = flagged.filter("not maybe").select("row.*")
    together = flagged.filter("maybe").groupBy("key").agg(F.first("row").alias("row"))
    return alone.union(together.join(touched.filter("not kept"), "key", "left_anti").select("row.*"))
