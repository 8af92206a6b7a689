"""A store of token ids: shards of raw ids, and a minimal perfect hash index from keys to places.

Shard file: MAGIC, ids; then each document's key, and the place of each one's first id; and a
trailer (ids, documents, bytes of an id, MAGIC). Index file: one bucket of the keys; the levels of a minimal perfect hash, its bits, the ones
before each word of bits, and by the hash's value entries of fingerprint, shard, slot in the shard, documents under that key.

``Store.get`` looks up one key: a few reads of fixed places in one index file and one shard, and the document's ids,
whatever the size of the store. ``Store.lookup`` looks up many: a task reads the index files and the tables of
places of its buckets and shards once, and each document's ids by their place.
"""

from __future__ import annotations

import math
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fresh_path, local_fs
from .tokens import CHUNK_ROWS, STRETCH, cuts, encoder, tokenizer_path

MAGIC, INDEX_MAGIC = b"TOKSHRD1", b"TOKINDX1"
TRAILER = "<QQQ8s"
TAIL = struct.calcsize(TRAILER)
#: Bytes of text a shard is made for, keys a bucket is made for, and the most of each.
SHARD_TEXT, BUCKET_KEYS, MOST_FILES = 32 << 20, 1 << 16, 8192
#: Stands for a null doc_id.
NULL_KEY = -(1 << 63)
#: Bytes before the sizes of an index file's levels.
HEAD = 32
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("slot", "<u4"), ("run", "<u4")])


# --- minimal perfect hashing ---


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64 mixed bits of each key (one to one for a given salt)."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers n distinct keys from 0 to n - 1, in about 3 bits a key and without holding them.

    Level by level, keys that alone hit a bit of the level's array set it; the others go on to the
    next level. A key's number is the rank of its bit.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])) if len(words) else np.zeros(0, np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, arrays, left = [], [], keys
        while len(left):
            size = -(-max(64, 2 * len(left)) // 64) * 64
            at = (mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(arrays) if arrays else np.zeros(0, "<u8"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; a key that was not among those built from gets -1 or any number."""
        out, base, open_ = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[open_], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = (base + at) >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_, base = open_[~hit], base + size
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 0x5EED) >> np.uint64(32)).astype(np.uint32)


class Bucket:
    """One index file."""

    def __init__(self, hash_: PerfectHash, entries: np.ndarray):
        self.hash, self.entries = hash_, entries

    @classmethod
    def build(cls, keys: np.ndarray, shard, slot, run) -> Bucket:
        bits = keys.astype(np.int64).view(np.uint64)
        hash_ = PerfectHash.build(bits)
        entries = np.zeros(len(keys), ENTRY)
        where = hash_(bits)
        for name, values in (("print", fingerprint(bits)), ("shard", shard), ("slot", slot), ("run", run)):
            entries[name][where] = values
        return cls(hash_, entries)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.hash.sizes), len(self.hash.words), len(self.entries), *self.hash.sizes], "<u8")
        return INDEX_MAGIC + head.tobytes() + self.hash.words.astype("<u8").tobytes() + self.hash.before.astype("<u4").tobytes() + self.entries.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bucket:
        if raw[:8] != INDEX_MAGIC:
            raise ValueError("not an index file")
        levels, words, entries = np.frombuffer(raw, "<u8", 3, 8).tolist()
        at = HEAD + 8 * levels
        return cls(PerfectHash(np.frombuffer(raw, "<u8", levels, HEAD).tolist(), np.frombuffer(raw, "<u8", words, at)), np.frombuffer(raw, ENTRY, entries, at + 12 * words))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of keys; run 0 where the fingerprint tells that a key is not in the store."""
        bits = keys.astype(np.int64).view(np.uint64)
        where = self.hash(bits)
        out = np.zeros(len(keys), ENTRY)
        inside = where >= 0
        out[inside] = self.entries[where[inside]]
        out["run"][out["print"] != fingerprint(bits)] = 0
        return out


def find_one(uri: str, key: int) -> np.void | None:
    """The entry of one key, by reads of fixed places of an index file: the head, two for each level, one entry."""
    bits = np.array([key], np.int64).view(np.uint64)
    fs, path = local_fs(uri)
    with fs.open_input_file(path) as file:
        read = lambda at, n, kind: np.frombuffer(file.read_at(n * np.dtype(kind).itemsize, at), kind)
        if file.read_at(8, 0) != INDEX_MAGIC:
            raise ValueError(f"{uri} is not an index file")
        levels, words, _ = read(8, 3, "<u8").tolist()
        first, base = HEAD + 8 * levels, 0
        for level, size in enumerate(read(HEAD, levels, "<u8").tolist()):
            at = int((mixed(bits, level + 1) % np.uint64(size))[0])
            word = (base + at) >> 6
            own = int(read(first + 8 * word, 1, "<u8")[0])
            if own >> (at & 63) & 1:
                before = int(read(first + 8 * words + 4 * word, 1, "<u4")[0])
                number = before + (own & ((1 << (at & 63)) - 1)).bit_count()
                entry = read(first + 12 * words + ENTRY.itemsize * number, 1, ENTRY)[0]
                return entry if entry["print"] == fingerprint(bits)[0] else None
            base += size
    return None


# --- shards ---


class Shard:
    """Reads one shard file."""

    def __init__(self, uri: str):
        fs, path = local_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        self.n_ids, self.n_docs, self.width, magic = struct.unpack(TRAILER, self.file.read_at(TAIL, end - TAIL))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard file")
        self.table = end - TAIL - 16 * self.n_docs

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, first ids) of all documents, for many look-ups; after the last comes the number of ids."""
        table = np.frombuffer(self.file.read_at(16 * self.n_docs + 8, self.table), "<i8")
        return table[: self.n_docs], table[self.n_docs :]

    def place(self, slot: int) -> tuple[int, int, int]:
        """(key, first id, past the last id) of one document, by two reads."""
        key = int(np.frombuffer(self.file.read_at(8, self.table + 8 * slot), "<i8")[0])
        lo, hi = np.frombuffer(self.file.read_at(16, self.table + 8 * (self.n_docs + slot)), "<i8").tolist()  # the trailer begins with the ids' number
        return key, lo, hi

    def ids(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, len(MAGIC) + lo * self.width), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def _write_shards(folder: str, width: int):
    """Writes the rows of a partition, sorted by key, as one file; tells the place of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, keys, starts, at = None, TaskContext.get().partitionId(), array("q"), array("q"), 0
        name = f"{folder}/shard-{shard:05d}-{uuid.uuid4().hex}.ids"  # of this attempt alone
        for batch in batches:
            if batch.num_rows and out is None:
                fs, path = local_fs(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path)
                out.write(MAGIC)
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids")):
                raw = ids.as_buffer()
                out.write(raw)
                keys.append(key)
                starts.append(at)
                at += raw.size // width
        if out is None:
            return
        ks, ss = np.array(keys, "<i8"), np.array(starts, "<i8")
        out.write(ks.tobytes() + ss.tobytes() + struct.pack(TRAILER, at, len(ks), width, MAGIC))
        out.close()
        slots = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
        runs = np.diff(np.append(slots, len(ks)))
        for lo in range(0, len(slots), 1 << 16):
            s = slots[lo : lo + (1 << 16)]
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(ks[s]), pa.array(np.full(n, shard, np.int32)), pa.array(s.astype(np.int64)), pa.array(runs[lo : lo + n].astype(np.int64)), pa.array([name] * n), pa.array(np.full(n, at, np.int64))], ["key", "shard", "slot", "run", "file", "shard_ids"])

    return run


def _encode(path: str, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, edges = encoder(path), np.array(bounds, np.int64)
        for batch in batches:
            for lo, hi in cuts(batch.column(1), STRETCH, CHUNK_ROWS):
                at = batch.column(0).slice(lo, hi - lo).to_numpy()
                flat, ends = encode.encode(batch.column(1).slice(lo, hi - lo))
                places = np.append(0, ends * flat.itemsize).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.searchsorted(edges, at, "right").astype(np.int32)), ids], ["key", "shard", "ids"])

    return run


@dataclass
class Store:
    """Where the files are: ``shards`` (number -> file, ids before it), ``buckets`` (number -> file)."""

    spark: SparkSession
    shards: dict[int, tuple[str, int]]
    buckets: dict[int, str]
    n_shards: int
    n_buckets: int

    def get(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(place of the first id among all, ids) of the documents under one doc_id, read here by their places; none for a doc_id not in the store."""
        from xxhash import xxh64_intdigest

        key = NULL_KEY if doc_id is None else doc_id
        h = xxh64_intdigest(struct.pack("<q", key), 42)  # as the engine's xxhash64
        bucket = (h - (1 << 64) if h >> 63 else h) % self.n_buckets
        entry = find_one(self.buckets[bucket], key) if bucket in self.buckets else None
        if entry is None:
            return []
        uri, before = self.shards[int(entry["shard"])]
        shard, out = Shard(uri), []
        try:
            for slot in range(int(entry["slot"]), int(entry["slot"]) + int(entry["run"])):
                own, lo, hi = shard.place(slot)
                if own == key:  # else another key's fingerprint was equal
                    out.append((before + lo, shard.ids(lo, hi)))
        finally:
            shard.close()
        return out

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, start, ids) of the documents under each of ``keys`` (a column ``key``, each once), through the index."""
        placed = _by_bucket(keys, self.n_buckets).mapInArrow(_find(self.buckets), "key long, shard int, slot long, run long")
        near = placed.repartitionById(self.n_shards, F.col("shard")).sortWithinPartitions("shard", "slot")
        return near.mapInArrow(_fetch(self.shards), "doc_id long, start long, n_tokens long, ids binary")


def _by_bucket(df: DataFrame, n: int) -> DataFrame:
    keyed = df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    return keyed.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")


def _find(files: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number = None, None
        for batch in batches:
            keys, of = batch.column("key").to_numpy(zero_copy_only=False), batch.column("bucket").to_numpy(zero_copy_only=False)
            for b in np.unique(of).tolist():
                if b != number and b in files:
                    fs, path = local_fs(files[b])
                    with fs.open_input_stream(path) as f:
                        bucket, number = Bucket.from_bytes(f.read()), b
                asked = keys[of == b]
                found = bucket.find(asked) if b in files else np.zeros(len(asked), ENTRY)
                there = found["run"] > 0
                yield pa.RecordBatch.from_arrays([pa.array(asked[there]), pa.array(found["shard"][there].astype(np.int32)), *(pa.array(found[c][there].astype(np.int64)) for c in ("slot", "run"))], ["key", "shard", "slot", "run"])

    return run


def _fetch(files: dict[int, tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, base = None, None, 0
        rows: list[tuple] = []
        size = 0

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for key, s, slot, n in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "slot", "run"))):
                if s != number:
                    if shard:
                        shard.close()
                    shard, number, base = Shard(files[s][0]), s, files[s][1]
                    keys, starts = shard.places()
                for k in range(slot, slot + n):
                    if int(keys[k]) != key:
                        continue  # another key's fingerprint was equal
                    ids = shard.ids(int(starts[k]), int(starts[k + 1])).astype("<u4").tobytes()
                    rows.append((None if key == NULL_KEY else key, base + int(starts[k]), len(ids) // 4, ids))
                    size += len(ids)
                    if size > 1 << 22 or len(rows) >= 4096:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return run


def _build_bucket(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        of = t.column("bucket").to_numpy()
        for b in np.unique(of).tolist():
            keys, shard, slot, n = (t.column(c).to_numpy()[of == b] for c in ("key", "shard", "slot", "run"))
            name = f"{folder}/index-{b:05d}-{uuid.uuid4().hex}.mph"
            fs, path = local_fs(name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(Bucket.build(keys, shard, slot, n).to_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([name])], ["bucket", "file"])

    return run


def keys_of(docs: DataFrame) -> DataFrame:
    return documents(docs).select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), "text")


def write_store(docs: DataFrame, tokenizer: str | None = None, shard_text: int = SHARD_TEXT) -> Store:
    """Encode every text, write ids in ascending doc_id order, and index them by doc_id.

    Shards are ranges of doc_id, bounded by its quantiles; their number follows the bytes of text (MOST_FILES
    at most: larger shards then, written as a stream). Each attempt of a task writes files of its own; only those of attempts
    that succeeded are named in the table of keys, so repeated or lost tasks do no harm.

    A null or empty text gives one id, the end id. Equal doc_ids stay next to each other, the
    shorter first; a null doc_id comes before all others and shares the key NULL_KEY, so a document of that very doc_id is told as one
    of none. A text of any length is one document of one shard. An empty table gives a store without files. Other columns are not read.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    keyed, folder = keys_of(docs), fresh_path(docs.sparkSession, "token-store")
    rows, text = keyed.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n_shards = max(1, min(MOST_FILES, math.ceil((text or 0) / shard_text)))
    bounds: list[int] = []
    if n_shards > 1:
        fractions = [i / n_shards for i in range(1, n_shards)]
        bounds = sorted(keyed.agg(F.percentile_approx("key", fractions, max(10_000, 10 * n_shards))).first()[0])
    coded = keyed.mapInArrow(_encode(path, bounds), "key long, shard int, ids binary")
    ordered = coded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("key", F.length("ids"), "ids")
    places = cut(ordered.mapInArrow(_write_shards(folder, encoder(path).dtype.itemsize), "key long, shard int, slot long, run long, file string, shard_ids long"), "token-places")
    shards, before = {}, 0
    for s in places.select("shard", "file", "shard_ids").distinct().orderBy("shard").collect():  # MOST_FILES rows at most
        shards[s["shard"]] = (s["file"], before)
        before += s["shard_ids"]
    n_buckets = max(1, min(MOST_FILES, math.ceil(rows / BUCKET_KEYS)))
    built = _by_bucket(places.select("key", "shard", "slot", "run"), n_buckets).mapInArrow(_build_bucket(folder), "bucket int, file string")
    return Store(spark, shards, {r["bucket"]: r["file"] for r in built.collect()}, n_shards, n_buckets)


def read_all(store: Store, docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of ``docs``, fetched from the store by its key."""
    return store.lookup(keys_of(docs).select("key").distinct())
