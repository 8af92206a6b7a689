"""Suffix-array dedup: byte strings that occur more than once are removed wherever they occur."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut, documents, n_tasks
from .substring_dedup import COVERED, _covered, _route
from .winnow import CUT_RUNS, GATHERED, Rolling, blocks_of, find_runs, identified, in_filter, merged, mix, repeated_anchors, spans_of, with_spans

#: Bytes of the shortest repeat, and of a k-gram.
SPAN, GRAM = 200, 32
#: Places of an anchor beyond which its windows travel one by one.
HOT_PLACES = 1 << 14
#: Stands between texts in a suffix array; no byte of UTF-8.
BETWEEN = 0xFF
#: Bytes sorted at a time in a task.
SORTED_BYTES = 2 << 20

RUNS = "route long, anchor long, digest long, id long, key long, first long, past long, many boolean, twice boolean, units binary"
#: A random value for each byte, for rolling hashes.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


# --- suffix array ---


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix one byte on; the last one is not."""
    step = np.sign(text[1:].astype(np.int16) - text[:-1])  # 0: as the next
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, -1)[nearest] > 0, False)


def words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from every place on, as numbers that sort like them; past the end, zeros."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    n, out = len(text) + depth + 8, np.zeros(len(text) + depth + 8, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + n]
    return out


def sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` bytes from each on: eight at a time, only where the ones before are equal."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    new = np.append(True, key[1:] != key[:-1])
    tied = ~new | ~np.append(new[1:], True)
    for d in range(8, depth, 8):
        open_ = np.flatnonzero(tied)
        if not len(open_):
            break
        key, starts = words[at[open_] + d], new[open_]
        group = np.cumsum(starts)
        differs = np.append(False, (key[1:] != key[:-1]) & ~starts[1:])
        if differs.any():
            unsorted = np.zeros(int(group[-1]) + 1, bool)
            unsorted[group[differs]] = True
            u = np.flatnonzero(unsorted[group])
            order = u[np.lexsort((key[u], group[u]))]
            moved, key[u] = at[open_[order]], key[order]
            at[open_[u]] = moved
            starts = starts | np.append(False, (key[1:] != key[:-1]) & ~starts[1:])
            new[open_] = starts
            tied[open_] = ~starts | ~np.append(starts[1:], True)
    return at


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All places of ``text`` in the order of their suffixes, exact for the first ``depth`` bytes.

    Two stages. Suffixes smaller than their successors are sorted directly. The others are induced: buckets of
    first bytes are scanned in order, and each place met puts its predecessor, if that is the larger,
    next in the predecessor's bucket. A bucket is scanned a block at a time.
    """
    words = words_at(text, depth) if words is None else words
    small = smaller_than_next(text)
    direct = sort_directly(np.flatnonzero(small), words, depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)

    out = []
    induce(np.array([len(text)]))  # the empty suffix comes before all
    for c in range(256):
        done = 0
        while done < len(induced[c]):  # grows while it is scanned: runs of one byte
            block = induced[c][done:]
            done = len(induced[c])
            block = np.concatenate(block)
            out.append(block)
            induce(block)
        block = direct[edges[c] : edges[c + 1]]
        out.append(block)
        induce(block)
    return np.concatenate(out)


def share_prefix(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Whether each place in ``order`` and the next one have their first ``length`` bytes in common."""
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for d in range(0, length, 8):
        skip = np.uint64(8 * max(0, d + 8 - length))
        same = same[words[a[same] + d] >> skip == words[b[same] + d] >> skip]
    out = np.zeros(len(a), bool)
    out[same] = True
    return out


def repeated_windows(texts: list[bytes], span: int) -> list[np.ndarray]:
    """For each text, which of its windows of ``span`` bytes occur anywhere else in the texts."""
    joined = np.frombuffer(bytes([BETWEEN]).join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    words = words_at(joined, span)
    inside = np.zeros(len(joined) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths - span + 1, -1)
    inside = np.cumsum(inside) > 0
    order = suffix_array(joined, span, words)
    order = order[inside[order]]
    same = share_prefix(order, words, span)
    found = np.zeros(len(joined), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return [found[s : s + n - span + 1] for s, n in zip(starts.tolist(), lengths.tolist())]


# --- runs ---


def _chunks(batch: pa.RecordBatch, span: int, units: int = 1 << 20):
    held, owners, size = [], [], 0
    for id_, text, key in zip(batch.column(0), batch.column(1), batch.column(2)):
        raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and text.as_py() else np.zeros(0, np.uint8)
        for lo, hi in blocks_of(len(raw), span):
            held.append(raw[lo:hi])
            owners.append((id_.as_py(), key.as_py(), lo))
            size += hi - lo
            if size >= units:
                yield np.concatenate(held), np.array([len(h) for h in held]), owners
                held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.array([len(h) for h in held]), owners


def _anchors(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for units, lengths, _ in _chunks(batch, span):
                runs = find_runs(Rolling(BYTE_VALUES[units]), lengths, span, gram)
                if runs:
                    yield pa.RecordBatch.from_arrays([pa.array(runs.seen().view(np.int64))], ["anchor"])

    return run


def _out(route, anchor, digest, ids, keys, first, past, many, twice, units) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(anchor), 1 << 13):
        s = slice(lo, lo + (1 << 13))
        yield pa.RecordBatch.from_arrays([pa.array(route[s]), pa.array(anchor[s].view(np.int64)), pa.array(digest[s].view(np.int64)), pa.array(ids[s]), pa.array(keys[s]), pa.array(first[s]), pa.array(past[s]), pa.array(many[s]), pa.array(twice[s]), pa.array(units[s], pa.binary())], [c.split()[0] for c in RUNS.split(", ")])


def _one_by_one(span: int, anchor, ids, keys, first, twice, units) -> Iterator[pa.RecordBatch]:
    """Runs as windows, each under a key of all its bytes; of equal windows one goes on, marked, and all are covered."""
    from xxhash import xxh3_128_digest

    n = np.array([len(u) - span + 1 for u in units])
    windows = [u[i : i + span] for u, m in zip(units, n.tolist()) for i in range(m)]
    high, low = np.frombuffer(b"".join(map(xxh3_128_digest, windows)), np.uint64).reshape(-1, 2).T
    of = np.repeat(np.arange(len(n)), n)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((low, high))
    new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
    one, same = order[new], np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    again = np.bincount(same) > 1
    np.logical_or.at(again, same, twice[of])
    flags, edges = again[same], np.append(0, np.cumsum(n))
    done = [(r, first[r] + lo, first[r] + hi) for r in np.unique(of[flags]).tolist() for lo, hi in spans_of(flags[edges[r] : edges[r + 1]], span)]
    if done:
        r, lo, hi = (np.array(c, np.int64) for c in zip(*done))
        none = np.zeros(len(r), bool)
        yield from _out(_route(ids[r], lo, keys[r]), anchor[r], anchor[r], ids[r], keys[r], lo, hi, none, none, np.full(len(r), None, object))
    own, cuts, of, at = high[one], np.empty(len(one), object), of[one], at[one]
    cuts[:] = [windows[i] for i in one.tolist()]
    yield from _out(own.view(np.int64), own, low[one], ids[of], keys[of], at, at + span, np.zeros(len(one), bool), again, cuts)


class _Gathered:
    """Runs of one task. Of runs with equal bytes one goes on, marked; all of them are covered."""

    def __init__(self, span: int, hot: np.ndarray):
        self.span, self.hot, self.parts, self.count = span, hot, [], 0

    def add(self, *columns) -> None:
        self.parts.append(columns)
        self.count += len(columns[0])

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.count = [], 0
        order = np.lexsort([columns[i] for i in (4, 3, 2, 1, 0)])  # anchor, digest, id, key, first
        anchor, digest, ids, keys, first, n, many, units = (c[order] for c in columns)
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1]))
        again = np.append(False, ~fresh[1:] & (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (first[1:] == first[:-1]))
        group = np.cumsum(fresh) - 1
        twice = (np.bincount(group, weights=~again) > 1)[group]
        units[~fresh] = None
        route = np.where(fresh, anchor.view(np.int64), _route(ids, first, keys))
        hot = in_filter(anchor, self.hot) & fresh
        yield from _out(*(c[~again & ~hot] for c in (route, anchor, digest, ids, keys, first, first + n, many, twice, units)))
        hot = np.flatnonzero(hot)
        for lo in range(0, len(hot), CUT_RUNS):
            yield from _one_by_one(self.span, *(c[hot[lo : lo + CUT_RUNS]] for c in (anchor, ids, keys, first, twice, units)))


def _runs(span: int, gram: int, filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = filters.value
        held = _Gathered(span, hot)
        for batch in batches:
            for units, lengths, owners in _chunks(batch, span):
                rolling = Rolling(BYTE_VALUES[units])
                runs = find_runs(rolling, lengths, span, gram)
                if not runs:
                    continue
                maybe = in_filter(runs.anchor, repeated)
                block, at, n = runs.block[maybe], runs.at[maybe], runs.n[maybe] + span - 1
                if not len(at):
                    continue
                ids, keys, lo = (np.array(c, np.int64)[block] for c in zip(*owners))
                starts = (np.cumsum(lengths) - lengths)[block]
                raw, cuts = units.tobytes(), np.empty(len(at), object)
                cuts[:] = [raw[a : a + m] for a, m in zip(at.tolist(), n.tolist())]
                held.add(runs.anchor[maybe], rolling.stretch(at, n), ids, keys, lo + at - starts, n, runs.many[maybe], cuts)
                if held.count >= GATHERED // 5:
                    yield from held.out()
        yield from held.out()

    return run


def _compare(span: int, sorted_bytes: int = SORTED_BYTES):
    """Sorts the suffixes of the runs under some anchors; tells the bytes covered by windows that occur twice."""

    def covered(rows: list[tuple]) -> pa.RecordBatch:
        texts: dict[tuple, list[tuple]] = {}
        for row in rows:
            texts.setdefault(row[:2], []).append(row)
        under: dict[int, int] = {}
        for anchor, _ in texts:
            under[anchor] = under.get(anchor, 0) + 1
        out, sorted_, whole = [], [], set()
        for of, same in texts.items():
            if any(r[7] for r in same) or len({r[2:5] for r in same}) > 1:
                whole.add(of)
                out += [(r[2], r[3], r[4], r[5]) for r in same]
            if under[of[0]] > 1 or same[0][6]:
                sorted_.append(of)
        if sorted_:
            for of, flags in zip(sorted_, repeated_windows([texts[of][0][8] for of in sorted_], span)):
                if of not in whole:
                    *_, id_, key, first = texts[of][0][:5]
                    out += [(id_, key, first + a, first + b) for a, b in spans_of(flags, span)]
        return _covered(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            done = batch.filter(batch.column("units").is_null())
            if done.num_rows:
                yield done.select(["id", "key", "first", "past"])
            todo = batch.filter(batch.column("units").is_valid())
            for row in zip(*(todo.column(c).to_pylist() for c in ("anchor", "digest", "id", "key", "first", "past", "many", "twice", "units"))):
                if size >= sorted_bytes and row[0] != rows[-1][0]:
                    yield covered(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[8])
        if rows:
            yield covered(rows)

    return run


def repeated_bytes(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, key, first, past): bytes [first, past) of a document covered by strings that also start elsewhere."""
    ids = identified(documents(docs))
    filters, places = repeated_anchors(ids.mapInArrow(_anchors(span, gram), "anchor long"), HOT_PLACES)
    runs = ids.mapInArrow(_runs(span, gram, filters), RUNS)
    tasks = n_tasks(docs.sparkSession, places, 20_000)
    return cut(runs.repartition(tasks, "route").sortWithinPartitions("anchor").mapInArrow(_compare(span), COVERED), "repeats")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans")):
            raw = (text.as_buffer().to_pybytes() if text.is_valid and len(text.as_py()) else b"")
            gone, kept, at = merged([(s["first"], s["past"]) for s in spans.as_py() or ()]), [], 0
            for lo, hi in [*gone, (len(raw), len(raw))]:
                kept.append(raw[at:lo])
                at = hi
            kept = b"".join(kept)
            out.append((doc_id.as_py(), len(raw), len(raw) - len(kept), len(gone), kept, [{"first": a, "past": b} for a, b in gone]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def drop_repeated_bytes(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) of every row: its UTF-8 bytes without any repeated string.

    A byte goes if a string of ``span`` bytes that covers it also starts elsewhere, in any document or
    the same one; strings are judged on the input. Runs of windows meet under their anchors; each task sorts the
    suffixes of the different runs it got and compares neighbours. Equal runs are merged in each task before they
    shuffle and are repeats outright, so a text copied any number of times sends one run a task. Windows under an anchor of more than
    HOT_PLACES places go one by one, so that no task must hold all that surrounds a frequent phrase.

    A null text is empty; a very long one is taken in blocks that overlap. An empty table gives no rows; other columns are not read. Rows that
    repeat one doc_id and text count as one document and share its result; a null doc_id is a doc_id of its own. ``kept`` is binary: a cut may fall inside a character.
    """
    found = with_spans(documents(docs), repeated_bytes(docs, span, gram))
    return found.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<first long, past long>>")
