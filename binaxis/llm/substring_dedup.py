"""Substring dedup by seed and extend: repeated runs of words, kept only where they come first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut, documents, n_tasks
from .winnow import CUT_RUNS, GATHERED, Rolling, blocks_of, find_runs, identified, in_filter, merged, mix, repeated_anchors, spans_of, with_spans

#: Words of the shortest repeat, and of a seed.
SPAN, SEED_WORDS = 20, 6
#: Places of an anchor beyond which its windows travel one by one.
HOT_PLACES = 1 << 16

RUNS = "route long, anchor long, id long, key long, first long, windows binary, past long"
COVERED = "id long, key long, first long, past long"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []  # of bytes: splits at ASCII white space


def _chunks(batch: pa.RecordBatch, span: int, units: int = 1 << 19):
    """Chunks of word hashes: (their array, lengths of blocks, (id, key, first word) of each block)."""
    from xxhash import xxh64_intdigest

    held, lengths, owners, size = [], [], [], 0
    for id_, text, key in zip(batch.column(0), batch.column(1), batch.column(2)):
        words = words_of(text.as_py())
        if len(words) < span:
            continue
        hashes = np.array([xxh64_intdigest(w) for w in words], np.uint64)
        for lo, hi in blocks_of(len(words), span):
            held.append(hashes[lo:hi])
            lengths.append(hi - lo)
            owners.append((id_.as_py(), key.as_py(), lo))
            size += hi - lo
            if size >= units:
                yield np.concatenate(held), np.array(lengths), owners
                held, lengths, owners, size = [], [], [], 0
    if held:
        yield np.concatenate(held), np.array(lengths), owners


def _anchors(span: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for units, lengths, _ in _chunks(batch, span):
                runs = find_runs(Rolling(units), lengths, span, seed)
                if runs:
                    yield pa.RecordBatch.from_arrays([pa.array(runs.seen().view(np.int64))], ["anchor"])

    return run


def _earliest(order_keys, groups) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row's place, least rank in its group); rows of one place share a rank."""
    order = np.lexsort(order_keys[::-1])
    new = np.zeros(len(order), bool)
    for k in order_keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    by = np.lexsort((rank, *groups[::-1]))
    edge = np.zeros(len(by), bool)
    edge[:1] = True
    for k in groups:
        s = k[by]
        edge[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(edge)
    least = np.empty(len(by), np.int64)
    least[by] = np.repeat(rank[by][first], np.diff(np.append(first, len(by))))
    return rank, least


def _route(ids: np.ndarray, first: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix((ids ^ (first << 20) ^ keys).view(np.uint64)).view(np.int64)


def _out(route, anchor, ids, keys, first, windows, past) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(anchor), 1 << 14):
        s = slice(lo, lo + (1 << 14))
        yield pa.RecordBatch.from_arrays([pa.array(route[s]), pa.array(anchor[s].view(np.int64)), pa.array(ids[s]), pa.array(keys[s]), pa.array(first[s]), pa.array(windows[s], pa.binary()), pa.array(past[s])], [c.split()[0] for c in RUNS.split(", ")])


def _one_by_one(span: int, anchor, ids, keys, first, windows) -> Iterator[pa.RecordBatch]:
    """Runs as windows, each under a key of all its words; of equal windows the earliest goes on, the others are covered."""
    n = np.array([len(w) >> 3 for w in windows])
    hashes = np.frombuffer(b"".join(windows), np.uint64)
    of = np.repeat(np.arange(len(n)), n)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    rank, least = _earliest((ids[of], keys[of], at), (anchor[of], hashes))
    late, edges = rank > least, np.append(0, np.cumsum(n))
    done = [(r, first[r] + lo, first[r] + hi) for r in np.unique(of[late]).tolist() for lo, hi in spans_of(late[edges[r] : edges[r + 1]], span)]
    if done:
        r, lo, hi = (np.array(c, np.int64) for c in zip(*done))
        yield from _out(_route(ids[r], lo, keys[r]), anchor[r], ids[r], keys[r], lo, np.full(len(r), None, object), hi)
    on = np.flatnonzero(~late)
    own, of, at = mix(anchor[of[on]] ^ hashes[on]), of[on], at[on]
    one = np.empty(len(on), object)
    one[:] = [h.tobytes() for h in hashes[on]]
    yield from _out(own.view(np.int64), own, ids[of], keys[of], at, one, at + span)


class _Gathered:
    """Runs of one task. Of runs with equal words only the earliest goes on; the others are covered."""

    def __init__(self, span: int, hot: np.ndarray):
        self.span, self.hot, self.parts, self.count = span, hot, [], 0

    def add(self, anchor, digest, ids, keys, first, n, windows: list[bytes]) -> None:
        self.parts.append((anchor, digest, ids, keys, first, n, np.array(windows, object)))
        self.count += len(anchor)

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        anchor, digest, ids, keys, first, n, windows = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.count = [], 0
        rank, least = _earliest((ids, keys, first), (anchor, digest))
        late = rank > least
        route = np.where(late, _route(ids, first, keys), anchor.view(np.int64))
        windows[late] = None
        hot = in_filter(anchor, self.hot) & ~late
        yield from _out(*(c[~hot] for c in (route, anchor, ids, keys, first, windows, first + n + self.span - 1)))
        hot = np.flatnonzero(hot)
        for lo in range(0, len(hot), CUT_RUNS):
            yield from _one_by_one(self.span, *(c[hot[lo : lo + CUT_RUNS]] for c in (anchor, ids, keys, first, windows)))


def _runs(span: int, seed: int, filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = filters.value
        held = _Gathered(span, hot)
        for batch in batches:
            for units, lengths, owners in _chunks(batch, span):
                rolling = Rolling(units)
                runs = find_runs(rolling, lengths, span, seed)
                if not runs:
                    continue
                maybe = in_filter(runs.anchor, repeated)
                block, at, n = runs.block[maybe], runs.at[maybe], runs.n[maybe]
                if not len(at):
                    continue
                ids, keys, lo = (np.array(c, np.int64)[block] for c in zip(*owners))
                starts = (np.cumsum(lengths) - lengths)[block]
                raw = rolling.every(span).tobytes()
                held.add(runs.anchor[maybe], rolling.stretch(at, n + span - 1), ids, keys, lo + at - starts, n, [raw[8 * a : 8 * (a + m)] for a, m in zip(at.tolist(), n.tolist())])
                if held.count >= GATHERED:
                    yield from held.out()
        yield from held.out()

    return run


def _extend(span: int, held_windows: int = 1 << 21):
    """Under each anchor, windows to both sides of the seed whose hash starts earlier elsewhere; tells the words that they cover."""

    def covered(rows: list[tuple]) -> pa.RecordBatch:
        anchor, ids, keys, first = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
        n = np.array([len(r[4]) >> 3 for r in rows])
        hashes = np.frombuffer(b"".join(r[4] for r in rows), np.uint64)
        of = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
        rank, least = _earliest((ids[of], keys[of], first[of] + inside), (anchor[of], hashes))
        late, edges, out = rank > least, np.append(0, np.cumsum(n)), []
        for r in np.unique(of[late]).tolist():
            out += [(ids[r], keys[r], first[r] + a, first[r] + b) for a, b in spans_of(late[edges[r] : edges[r + 1]], span)]
        return _covered(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            done = batch.filter(batch.column("windows").is_null())
            if done.num_rows:
                yield done.select(["id", "key", "first", "past"])
            todo = batch.filter(batch.column("windows").is_valid())
            for row in zip(*(todo.column(c).to_pylist() for c in ("anchor", "id", "key", "first", "windows"))):
                if size >= held_windows and row[0] != rows[-1][0]:
                    yield covered(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) >> 3
        if rows:
            yield covered(rows)

    return run


def _covered(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["id", "key", "first", "past"])


def repeated_words(docs: DataFrame, span: int = SPAN, seed: int = SEED_WORDS) -> DataFrame:
    """(id, key, first, past): words [first, past) of a document that lie in repeats which start earlier elsewhere."""
    ids = identified(documents(docs))
    filters, places = repeated_anchors(ids.mapInArrow(_anchors(span, seed), "anchor long"), HOT_PLACES)
    runs = ids.mapInArrow(_runs(span, seed, filters), RUNS)
    tasks = n_tasks(docs.sparkSession, places, 100_000)
    return cut(runs.repartition(tasks, "route").sortWithinPartitions("anchor").mapInArrow(_extend(span), COVERED), "repeats")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans")):
            words, gone = words_of(text.as_py()), merged([(s["first"], s["past"]) for s in spans.as_py() or ()])
            kept, at = [], 0
            for lo, hi in [*gone, (len(words), len(words))]:
                kept += words[at:lo]
                at = hi
            out.append((doc_id.as_py(), len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [{"first": a, "past": b} for a, b in gone]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["doc_id", "n_words", "n_removed", "kept", "repeats"])


def drop_repeated_words(docs: DataFrame, span: int = SPAN, seed: int = SEED_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats) of every row: its text without repeats that start earlier elsewhere.

    Documents join on winnowed seeds of ``seed`` words. Under a seed the windows of ``span`` words to both sides of it are told
    equal by their hashes, and ``repeats`` are the maximal stretches of windows that start earlier elsewhere.
    Windows are judged on the input. Earlier means a smaller doc_id, or an earlier start in the same document.
    Equal stretches under one seed are merged in each task before they shuffle, so a passage copied into
    any number of documents sends one row a task; windows under a seed of more than HOT_PLACES places go one by one.

    A null, empty or blank text has no words; a very long one is taken in blocks that overlap. An empty table gives no rows; other columns are not read. Rows that repeat one doc_id and text count as one document and share its
    result; rows of one doc_id with different texts are ordered by a hash of the text. A null doc_id comes before all others.
    """
    found = with_spans(documents(docs), repeated_words(docs, span, seed))
    return found.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<first long, past long>>")
