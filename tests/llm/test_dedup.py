"""Exact, substring, suffix-array and SimHash dedup against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import by_hand, bytes_removed, linked, sha, words_removed
from hypothesis import given, settings
from hypothesis import strategies as st

from binaxis.llm import bloom, common, exact_dedup, simhash, substring_dedup, suffix_dedup, winnow
from binaxis.llm.components import components

def test_exact(docs, rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[sha(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""))].append(doc_id)
    expected = sorted((d, min(g), len(g), d == min(g), s) for s, g in groups.items() for d in g)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == expected


@pytest.mark.parametrize("bits", [64, 512, 1 << 16])
def test_exact_with_any_filter(docs, rows, bits, monkeypatch):
    """A filter far too small, of one part or several, lets all rows shuffle and changes nothing."""
    wanted = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(bloom, "LEAST_BITS", bits)
    monkeypatch.setattr(bloom, "MOST_BITS", bits)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == wanted


def test_exact_odd_rows(odd, nothing):
    out = [tuple(r)[:4] for r in exact_dedup.exact_groups(odd).collect()]
    assert sorted(out, key=str) == sorted([(None, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True), (5, 5, 4, True), (6, 6, 1, True)], key=str)
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact(odd).collect()) == [5, 6]


def test_substrings(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.drop_repeated_words(docs).collect()}
    assert got == words_removed(rows, 20)


@pytest.mark.parametrize("hot", [1, 12])
def test_substrings_under_hot_seeds(docs, rows, hot, monkeypatch):
    """Windows that travel one by one, all of them or some, give the same."""
    monkeypatch.setattr(substring_dedup, "HOT_PLACES", hot)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.drop_repeated_words(docs).collect()}
    assert got == words_removed(rows, 20)


@pytest.mark.parametrize("windows", [30, 100])
def test_texts_of_many_blocks(docs, rows, windows, monkeypatch):
    """Texts longer than a block are taken in blocks that overlap; runs are cut short."""
    monkeypatch.setattr(winnow, "BLOCK_WINDOWS", windows)
    monkeypatch.setattr(winnow, "RUN_WINDOWS", 8)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.drop_repeated_words(docs).collect()}
    assert got == words_removed(rows, 20)
    monkeypatch.setattr(winnow, "BLOCK_WINDOWS", 10 * windows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffix_dedup.drop_repeated_bytes(docs).collect()}
    assert got == bytes_removed(rows, 200)


def test_substrings_odd_rows(odd, nothing):
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.drop_repeated_words(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, 40, 0), (5, 40, 40), (5, 40, 40), (5, 40, 40), (6, 41, 40)], key=str)
    assert substring_dedup.drop_repeated_words(nothing).count() == 0


def test_suffixes(docs, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffix_dedup.drop_repeated_bytes(docs).collect()}
    assert got == bytes_removed(rows, 200)


@pytest.mark.parametrize("hot", [1, 12])
def test_suffixes_under_hot_anchors(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PLACES", hot)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffix_dedup.drop_repeated_bytes(docs).collect()}
    assert got == bytes_removed(rows, 200)


def test_suffixes_odd_rows(odd, nothing, spark):
    long = odd.withColumn("text", __import__("pyspark.sql.functions", fromlist=["x"]).repeat("text", 3))
    got = {(r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.drop_repeated_bytes(long).collect()}
    assert got >= {(None, 0), (5, 0)}
    assert suffix_dedup.drop_repeated_bytes(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 + 97 for x in b)), st.sampled_from([8, 16, 24, 80]))
def test_suffix_array(text, depth):
    order = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), depth).tolist()
    assert sorted(order) == list(range(len(text)))
    keys = [text[i : i + depth] for i in order]
    assert keys == sorted(keys)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=5, max_size=60), min_size=1, max_size=5))
def test_repeated_windows(texts):
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + 5] for b in raw for i in range(len(b) - 4))
    got = suffix_dedup.repeated_windows(raw, 5)
    assert [g.tolist() for g in got] == [[seen[b[i : i + 5]] > 1 for i in range(len(b) - 4)] for b in raw]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=50), min_size=1, max_size=4))
def test_equal_windows_share_an_anchor(texts):
    """Every window lies in one run, and equal windows lie under one anchor."""
    units = [np.array(t, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for t in texts]
    lengths = np.array([len(u) for u in units])
    runs = winnow.find_runs(winnow.Rolling(np.concatenate(units)), lengths, 8, 3)
    starts, anchors, seen = np.cumsum(lengths) - lengths, {}, []
    if runs:
        for b, at, n, a in zip(runs.block.tolist(), runs.at.tolist(), runs.n.tolist(), runs.anchor.tolist()):
            for w in range(at - starts[b], at - starts[b] + n):
                anchors.setdefault(tuple(texts[b][w : w + 8]), set()).add(a)
                seen.append((b, int(w)))
    assert sorted(seen) == [(b, w) for b, t in enumerate(texts) for w in range(len(t) - 7)]
    assert all(len(a) == 1 for a in anchors.values())


def test_simhash(docs, rows):
    prints = {r[0]: by_hand(r[1]) for r in rows}
    roots = linked(prints, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", roots[d]) for d in prints}


def test_simhash_odd_rows(odd, nothing, spark):
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(odd).collect()} >= {(None, 5), (5, 5)}
    assert simhash.near_groups(nothing).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_groups(alone).collect()] == [None]


def test_drop_near_keeps_a_row_of_each_component(spark):
    """Null and repeated doc_ids: texts of different components all stay, near copies go."""
    rng = random.Random(5)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (7, e), (None, e), (9, f.upper()), (8, f), (None, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({by_hand(t) for t in (a, b, c, d, e, f)}) == 6
    kept = sorted(map(tuple, simhash.drop_near(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (None, c), (7, d), (7, e), (8, f)], key=str)


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_trie_join_finds_all_pairs(agree, monkeypatch):
    rng, size = random.Random(agree), {1: 100, 2: (1 << 22) + 1, 3: (1 << 30) + 1}[agree]
    near = [rng.getrandbits(64) for _ in range(60)]
    near += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for x in near for _ in range(5)]
    prints, found = np.unique(np.array(near, np.uint64)), set()
    monkeypatch.setattr(simhash, "HELD_PAIRS", 50)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 1)
    for spans, bits in simhash.block_tables(size):
        turned = simhash.turned(prints, spans)
        order = np.argsort(turned)
        for i, j in simhash.trie_pairs(turned[order], bits, 4):
            found |= {tuple(sorted(p)) for p in zip(order[i].tolist(), order[j].tolist())}
    n = len(prints)
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if int(prints[i] ^ prints[j]).bit_count() <= 4}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (None, 4)]
    root = {x: x for p in links if None not in p for x in p}
    for _ in range(100):
        for a, b in links:
            if None not in (a, b):
                root[a] = root[b] = min(root[a], root[b])
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != 300}


@pytest.mark.parametrize("share", [1, 3, 1 << 20])
def test_hot_groups_change_nothing(docs, share, monkeypatch):
    """No group hot, some, or all."""
    wanted = [sorted(map(tuple, f(docs).collect())) for f in (exact_dedup.exact_groups, simhash.near_groups)]
    monkeypatch.setattr(common, "HOT_SHARE", share)
    assert [sorted(map(tuple, f(docs).collect())) for f in (exact_dedup.exact_groups, simhash.near_groups)] == wanted


def test_components_with_hubs(spark):
    """Nodes with most of all links, as the least node, the greatest and one between, are told apart from the others and meet nowhere."""
    links = [(0, i) for i in range(10, 3000)] + [(9000, i) for i in range(4000, 6000)] + [(7000, i) for i in range(6500, 7500)]
    links += [(20000 + i, 20001 + i) for i in range(0, 60, 2)] + [(2999, 9000), (5, 5), (8, None)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b and b is not None:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert got == {x: root(x) for x in parent}
