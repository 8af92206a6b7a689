"""Approximate nearest neighbours by largest inner product, with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that codebooks are fitted on, at most; centroids of a half, at most; rounds of fitting.
FIT_ROWS, MOST_CENTROIDS, FIT_ROUNDS = 20_000, 256, 12
#: Queries whose true neighbours tell how many rows to visit, at most, and the share of these neighbours that must be among them.
TUNE_QUERIES, RECALL = 128, 0.95
#: Rows of a part of the index, and queries that a task ranks at a time.
PART_ROWS, RANKED_QUERIES = 8192, 128


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, vec): finite vectors other than zero of one dimension; one row per vec_id."""
    v = vectors["embedding"]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(v.isNotNull() & vectors["vec_id"].isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(vectors["vec_id"].cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"))
    if dim is None:
        common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = common["n"] if common else 0
    return rows.filter(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def fit_half(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centroids; a centroid that loses all rows stays where it is."""
    centroids = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(FIT_ROUNDS):
        near = nearest(rows, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, rows)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * rows @ centroids.T, axis=1)


def cells_in_order(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Pairs of centroids by rising summed distance, until their cells hold ``enough`` rows.

    ``a`` and ``b`` are a query's distances to the centroids of each half. The heap holds, for each first
    centroid reached, the next second centroid in its order.
    """
    first, second = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    da, db, k = a.tolist(), b.tolist(), len(b)
    heap, out, held = [(da[first[0]] + db[second[0]], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = first[i] * k + second[j]
        out.append(cell)
        held += counts[cell]
        if j + 1 < k:
            heapq.heappush(heap, (da[first[i]] + db[second[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (da[first[i + 1]] + db[second[0]], i + 1, 0))
    return out


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _encode(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("vec"))
                cell = nearest(rows[:, : a.shape[1]], a) * len(b) + nearest(rows[:, a.shape[1] :], b)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cell.astype(np.int32))], ["vec_id", "vec", "cell"])

    return run


# --- how many rows to visit ---


def _best(own: np.ndarray, asked: np.ndarray, ids: np.ndarray, x: np.ndarray, visited: np.ndarray | None, top: int):
    """(query number, place in x, score) of the ``top`` nearest rows of each query, nearest first, ties to the smaller id."""
    scores = own @ x.T if visited is None else visited
    scores = np.where(asked[:, None] != ids, scores, -np.inf)
    if len(x) > top:  # rounding differs between products, so a little below the last is looked at too
        least = np.partition(scores, -top, axis=1)[:, -top]
        reach = np.sqrt((own * own).sum(1) * (x * x).sum(1).max())
        scores[scores < (least - 1e-12 * reach)[:, None]] = -np.inf
    i, j = np.nonzero(scores > -np.inf)
    exact = (own[i] * x[j]).sum(axis=1)  # the same for equal vectors, wherever they lie
    order = np.lexsort((ids[j], -exact, i))
    rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
    order = order[rank < top]
    return i[order], j[order], exact[order]


def _true_nearest(asked: np.ndarray, own: np.ndarray, top: int):
    """The nearest rows of each partition to a few queries, by comparing all of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(lo, PART_ROWS)
                ids, x, cell = part.column("vec_id").to_numpy(), _matrix(part.column("vec")), part.column("cell").to_numpy()
                if held:
                    ids, x, cell = (np.concatenate(c) for c in zip(held, (ids, x, cell)))
                _, j, _ = _best(own, asked, ids, x, None, top)
                keep = np.unique(j)
                held = ids[keep], x[keep], cell[keep]
        if held:
            i, j, exact = _best(own, asked, *held[:2], None, top)
            yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(held[0][j]), pa.array(held[2][j]), pa.array(exact)], ["query_id", "vec_id", "cell", "score"])

    return run


def rows_to_visit(index: DataFrame, asked: DataFrame, books, counts: np.ndarray, top: int, recall: float, seed: int) -> int:
    """Rows that a query's cells must hold so that ``recall`` of the true neighbours of a few queries are among them.

    TUNE_QUERIES queries at most, taken by a hash of vec_id, are compared with every row.
    """
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id").limit(TUNE_QUERIES).toArrow()
    if not some.num_rows:
        return 0
    own, ids = _matrix(some.column("vec")), some.column("vec_id").to_numpy()
    found = index.mapInArrow(_true_nearest(ids, own, top), "query_id long, vec_id long, cell int, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true: dict[int, list[int]] = {}
    for r in found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).collect():  # TUNE_QUERIES x top rows at most
        true.setdefault(r["query_id"], []).append(r["cell"])
    needed: list[int] = []
    a, b = books
    for i, q in zip(ids.tolist(), own):
        order = cells_in_order(-q[: a.shape[1]] @ a.T, -q[a.shape[1] :] @ b.T, counts, int(counts.sum()))
        held = dict(zip(order, np.cumsum(counts[order]).tolist()))
        needed += [held[c] for c in true.get(i, ())]
    return int(np.quantile(needed, recall, method="higher")) if needed else 0


# --- lists ---


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first part of each cell, parts of each cell, parts in all): neighbouring cells share a part, a cell of very many rows has several."""
    first, pieces, part, filled = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if filled and filled + n > PART_ROWS:
            part, filled = part + 1, 0
        first[cell] = part
        if n > PART_ROWS:
            pieces[cell] = -(-n // PART_ROWS)
            part, filled = part + int(pieces[cell]), 0
        else:
            filled += n
    return first, pieces, part + (filled > 0)


LISTS = "part int, kind int, id long, vec array<double>, cell int, cells binary"
LIST_NAMES = [c.split()[0] for c in LISTS.split(", ")]


def _rows_of_lists(first, pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
            spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = first[cell] + (spread % pieces[cell].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.zeros(len(ids), np.int32)), batch.column("vec_id"), batch.column("vec"), batch.column("cell"), pa.nulls(len(ids), pa.binary())], LIST_NAMES)

    return run


def _visits(books, counts, enough: int, first, pieces):
    """Each query once for each part that holds cells it visits, with these cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                own = batch.slice(lo, 64)
                rows = _matrix(own.column("vec"))
                of, parts, cells = [], [], []
                for i, (da, db) in enumerate(zip(-rows[:, : a.shape[1]] @ a.T, -rows[:, a.shape[1] :] @ b.T)):
                    visited = np.sort(np.array(cells_in_order(da, db, counts, enough), np.int32))
                    visited = visited[counts[visited] > 0]
                    edges = np.flatnonzero(np.append(True, first[visited][1:] != first[visited][:-1])) if len(visited) else []
                    for x, y in zip(edges, np.append(edges[1:], len(visited)).astype(int)):
                        for k in range(int(pieces[visited[x]])):
                            of.append(i)
                            parts.append(int(first[visited[x]]) + k)
                            cells.append(visited[x:y].tobytes())
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.ones(len(of), np.int32)), own.column("vec_id").take(take), own.column("vec").take(take), pa.nulls(len(of), pa.int32()), pa.array(cells, pa.binary())], LIST_NAMES)

    return run


def _rank(top: int):
    """Of each part its rows come first, by cell, then the queries that visit it; a query meets the rows of its cells alone."""

    def nearest_of(held: list, queries: pa.RecordBatch) -> pa.RecordBatch:
        if len(held[0]) > 1:
            held[:] = [[np.concatenate(c)] for c in held]
        (ids,), (x,), (cell,) = held
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        ends, here = np.append(starts[1:], len(cell)), cell[starts]
        own, asked = _matrix(queries.column("vec")), queries.column("id").to_numpy()
        lists = [np.frombuffer(c, np.int32) for c in queries.column("cells").to_pylist()]
        who, what = np.repeat(np.arange(len(own)), [len(c) for c in lists]), np.concatenate(lists)
        at = np.searchsorted(here, what)
        there = (at < len(here)) & (here[np.minimum(at, len(here) - 1)] == what)  # a piece of a cell may be empty
        who, at = who[there], at[there]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        scores = np.full((len(own), len(x)), -np.inf)
        edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
        for lo, hi in zip(edges, np.append(edges[1:], len(at)).astype(int)):
            s, e = starts[at[lo]], ends[at[lo]]
            scores[who[lo:hi], s:e] = own[who[lo:hi]] @ x[s:e].T
        i, j, exact = _best(own, asked, ids, x, scores, top)
        return pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[j]), pa.array(exact)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, [[], [], []]
        for batch in batches:
            of, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]))) if len(of) else []
            for lo, hi in zip(edges, np.append(edges[1:], len(of)).astype(int)):
                if of[lo] != part:
                    part, held = of[lo], [[], [], []]
                own = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    for c, values in zip(held, (own.column("id").to_numpy(), _matrix(own.column("vec")), own.column("cell").to_numpy())):
                        c.append(values)
                elif held[0]:
                    for at in range(0, own.num_rows, RANKED_QUERIES):
                        yield nearest_of(held, own.slice(at, RANKED_QUERIES))

    return run


def neighbours(vectors: DataFrame, is_query: Column, top: int = 20, recall: float = RECALL, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found for each query, nearest first.

    ``is_query`` is a condition on vec_id. Codebooks for the two halves of the vectors are fitted on FIT_ROWS rows at most, taken by a hash
    of vec_id; every row is listed under its pair of centroids. A query visits pairs by summed distance, with a heap,
    until their lists hold enough rows, and the rows in them are ranked by their exact inner
    products. How many are enough follows from the true neighbours of a few queries (rows_to_visit), so that ``recall`` of them are found.
    Vectors spread evenly over a sphere need about half of the rows; clustered ones far less.

    Lists are dealt to parts of about PART_ROWS rows; a list of very many rows has several. A query travels to the parts that hold lists it
    visits, and there meets the rows of these lists alone; of each part its nearest ``top`` go on. Of equal
    vectors only the top + 1 of least vec_id are listed, since ties go to the smaller vec_id.

    Null, zero and non-finite vectors, null vec_ids, and vectors not of the commonest length take no part; of a
    repeated vec_id the least vector does. An empty table, or one without queries, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(FIT_ROWS).select("vec").toArrow().column("vec"))
    half, rng = max(1, sample.shape[1] // 2), np.random.default_rng(seed)
    k = max(1, min(MOST_CENTROIDS, len(sample), round(math.sqrt(n) / 8)))
    books = fit_half(sample[:, :half], k, rng), fit_half(sample[:, half:], k, rng)
    coded = cut(rows.mapInArrow(_encode(books), "vec_id long, vec array<double>, cell int"), "coded")
    alike = Window.partitionBy("vec").orderBy("vec_id")
    index = cut(coded.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= top + 1).drop("_n"), "index")
    counts = np.zeros(k * k, np.int64)
    for r in index.groupBy("cell").count().collect():  # MOST_CENTROIDS squared rows at most
        counts[r["cell"]] = r["count"]
    asked = rows.filter(is_query)
    enough = max(top + 1, rows_to_visit(index, asked, books, counts, top, recall, seed))  # the query's own row is one of them
    first, pieces, parts = layout(counts)
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_visits(books, counts, enough, first, pieces), LISTS)
    met = index.mapInArrow(_rows_of_lists(first, pieces), LISTS).union(asked)
    near = met.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "cell").mapInArrow(_rank(top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
