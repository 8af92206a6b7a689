"""Packing and the token store against the tokenizers library itself."""

import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from binaxis.llm import packing, token_store, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


@pytest.fixture(scope="module")
def ids(library, rows):
    encoded = library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)
    return {r[0]: [*e.ids, tokens.END_ID] for r, e in zip(rows, encoded)}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PIECES = ["a", "Zé", ".", ", ", " ", "  ", "\n", "\t", "|", "'s", "Σς", "İ", "½", "1٣", "中文", " ́", "é", "<", "<|endoftext|>", "<|startoftext|>", "\x1c", "\u0085", "ǅ", "Abc.,", "é!!", "x" * 70, "$%", "#3)"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=20).map("".join), st.text(max_size=20)), min_size=1, max_size=6))
def test_same_ids_as_the_library(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    encoder = tokens.encoder(tokens.tokenizer_path())
    flat, ends = encoder.encode(pa.array(texts, pa.string()))
    wanted = [[*e.ids, tokens.END_ID] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == wanted


def test_small_memory_same_ids(monkeypatch, rows, ids):
    monkeypatch.setattr(tokens, "KEEP_PIECES", 20)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for r in rows:
        flat, _ = encoder.encode(pa.array([r[1]], pa.string()))
        assert flat.tolist() == ids[r[0]]


def test_long_texts_go_through_in_stretches(monkeypatch, library):
    monkeypatch.setattr(tokens, "STRETCH", 1000)
    monkeypatch.setattr(tokens, "AT_ONCE", 64)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for text in ("Some words, é. " * 400, "no space:" + "a1,b2;c" * 900, "x" * 3000, "\n".join(["12,the;<|endoftext|>"] * 200), "end " * 600 + "\n"):
        flat, ends = encoder.encode(pa.array([text]))
        assert flat.tolist() == [*library.encode(text, add_special_tokens=False).ids, tokens.END_ID] and ends.tolist() == [len(flat)]


def test_another_vocabulary():
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    texts = ["Some words,  and\nlines. ", "", None, "é x"]
    flat, ends = encoder.encode(pa.array(texts))
    wanted = [[*e.ids, tokens.END_ID] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == wanted


def test_memory_of_a_worker_is_bounded():
    """Texts of words that never come again: what a worker holds does not follow the number of words."""
    code = """
import resource, random, pyarrow as pa
from binaxis.llm import tokens
encoder, r = tokens.Encoder(tokens.tokenizer_path()), random.Random(1)
peak = []
for turn in range(6):
    texts = [" ".join("".join(r.choices("abcdefghijklm", k=9)) for _ in range(200)) for _ in range(2000)]
    for lo, hi in tokens.cuts(pa.array(texts), tokens.STRETCH, tokens.CHUNK_ROWS):
        encoder.encode(pa.array(texts[lo:hi]))
    peak.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
print(peak[1], peak[-1])
"""
    early, late = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split())
    assert late < 600 and late - early < 100


def checked(pieces, ids, padded=4096):
    """Every id in one piece, windows gapless from 0; returns the padding."""
    of, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == crc(own[p["start"] : p["start"] + p["length"]])
        of[p["doc_id"]].append((p["start"], p["length"]))
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, parts in of.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert set(of) == set(ids)
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= padded
        padding += 0 if at & (at - 1) == 0 else padded - at
    return padding


@pytest.mark.parametrize("waiting", [packing.WAITING_IDS, 500])
def test_packing(docs, ids, waiting):
    pieces = packing.pack(docs, waiting_ids=waiting).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert checked(pieces, ids) == 0


def test_packing_odd_rows(odd, nothing):
    pieces = packing.pack(odd).collect()
    placed, tokens_of = defaultdict(int), {}
    for p in pieces:
        placed[p["doc_id"]] += p["length"]
        tokens_of[p["doc_id"]] = p["doc_tokens"]
    assert placed == {d: tokens_of[d] * rows for d, rows in ((None, 1), (5, 3), (6, 1))}
    assert packing.pack(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=60))
def test_packer_places_all_ids_in_full_windows(sizes):
    packer, windows = packing.Packer(), []
    for i, n in enumerate(sizes):
        windows += packer.add(i, n)
    windows += packer.flush(last=False)
    assert all(w in packing.TIERS for w, _ in windows)
    windows += packer.flush(last=True)
    assert all(sum(n for *_, n in pieces) == w and w & (w - 1) == 0 for w, pieces in windows)
    assert sum(w for w, _ in windows) == sum(sizes)


def test_step_groups_are_even():
    sizes = [4096] * 100 + [512] * 77 + [1024] * 31
    groups = packing.step_groups(sizes, 64 * 4096)
    loads = np.bincount(groups, weights=sizes)
    assert loads.max() - loads.min() <= 4096 and len(loads) == -(-sum(sizes) // (64 * 4096))


@pytest.mark.parametrize("shard_text", [token_store.SHARD_TEXT, 3000])
def test_store(docs, rows, ids, shard_text):
    store = token_store.write_store(docs, shard_text=shard_text)
    assert (store.n_shards > 1) == (shard_text == 3000)
    got = {r["doc_id"]: (r["start"], list(np.frombuffer(bytes(r["ids"]), "<u4"))) for r in token_store.read_all(store, docs).collect()}
    at = 0
    for d in sorted(ids):
        assert got[d] == (at, ids[d])
        at += len(ids[d])
    assert len(got) == len(ids)


def test_store_keyed_access(docs, spark, ids):
    store = token_store.write_store(docs, shard_text=3000)
    asked = spark.createDataFrame([(3,), (7,), (10**9,), (-4,)], "key long")
    assert sorted(r["doc_id"] for r in store.lookup(asked).collect()) == [3, 7]
    at = 0
    for d in sorted(ids):
        assert [(start, own.tolist()) for start, own in store.get(d)] == [(at, ids[d])]
        at += len(ids[d])
    assert all(store.get(d) == [] for d in (None, -4, 10**9, 2**62))


def test_one_look_up_reads_a_few_places(docs, monkeypatch):
    """Reads and bytes of a look-up follow the document alone, however many documents there are."""
    store, read = token_store.write_store(docs), []
    whole = token_store.local_fs

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    def counted(uri):
        fs, path = whole(uri)
        return type("Fs", (), {"open_input_file": staticmethod(lambda p: Counted(fs.open_input_file(p)))}), path

    monkeypatch.setattr(token_store, "local_fs", counted)
    for d in range(0, 120, 7):
        read.clear()
        ((_, own),) = store.get(d)
        assert len(read) <= 40 and sum(read) <= 600 + 2 * len(own)


def test_store_odd_rows(odd, nothing):
    out = token_store.read_all(token_store.write_store(odd), odd).collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted([None, 5, 5, 5, 6], key=str)
    spans = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and next(r["start"] for r in out if r["doc_id"] is None) == 0
    store = token_store.write_store(odd)
    assert [len(store.get(d)) for d in (None, 5, 6, 7)] == [1, 3, 1, 0]
    empty = token_store.write_store(nothing)
    assert token_store.read_all(empty, nothing).count() == 0 and empty.get(1) == []


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    found = token_store.PerfectHash.build(keys.view(np.uint64))(keys.view(np.uint64))
    assert sorted(found.tolist()) == list(range(len(keys)))
    bucket = token_store.Bucket.from_bytes(token_store.Bucket.build(keys, np.arange(len(keys)), np.arange(len(keys)) * 2, np.ones(len(keys), int)).to_bytes())
    assert bucket.find(keys)["shard"].tolist() == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1000, dtype=np.int64), keys)
    assert (bucket.find(others)["run"] > 0).sum() <= 1  # a fingerprint of 32 bits
