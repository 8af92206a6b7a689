"""The registered queries on small tables, against brute force over the same tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import by_hand, bytes_removed, linked, words_removed
from tokenizers import Tokenizer

from binaxis.llm import langid, mixing, queries, tokens, toxicity

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(at / "documents.parquet"))
    labels = [(r[0], 0, int("a" in (r[1] or "")[:3])) for r in rows if r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(str(at / "embeddings.parquet"))
    return str(at)


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


@pytest.fixture(scope="module")
def ids(rows):
    library = Tokenizer.from_file(tokens.tokenizer_path())
    return {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, tokens.END_ID] for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, folder, ids):
    at = defaultdict(int)
    for r in sorted(run(spark, folder, "op1_packing"), key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at[r["doc_id"]], len(own), crc(own[r["start"] : r["start"] + r["length"]]))
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(own) for d, own in ids.items()}


def test_op8(spark, folder, ids):
    got, start = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, folder, "op8_token_store")}, 0
    for d in sorted(ids):
        assert got[d] == (start, len(ids[d]), crc(ids[d]))
        start += len(ids[d])
    assert len(got) == len(ids)


def test_op2(spark, folder, docs, rows):
    """Languages by adding up, codeword by codeword, what each classifier loses on it."""
    got = {r["doc_id"]: r for r in run(spark, folder, "op2_langid")}
    model = langid.train(docs, queries.F.coalesce(queries.fold(queries.F.col("doc_id"), 3) != 1, queries.F.lit(False)))
    assert model.languages == ["en", "fr"] and set(got) == {r[0] for r in rows}
    for d, text, *_ in rows:
        assert got[d]["held_out"] == (remainder(d, 3) == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        own = langid.features(text).astype(float)
        losses = []
        for word in model.code:
            loss = 0.0
            for bit, sign in enumerate(word):
                margin = float(own @ model.weights[:, bit].astype(float)) + float(model.bias[bit])
                loss += float(model.trust[bit]) * float(np.log1p(np.exp(-sign * margin)))
            losses.append(loss)
        odds = [np.exp(min(losses) - x) for x in losses]
        best = int(np.argmin(losses))
        assert got[d]["score"] == pytest.approx(odds[best] / sum(odds), abs=1e-3)
        assert got[d]["lang_pred"] == model.languages[best] or abs(losses[0] - losses[1]) < 1e-3


def test_op2_features():
    """Byte bigrams and trigrams of the lower-cased text, counted one by one."""
    text = "Ab, éa  B2ab"
    folded = bytes([32]) + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + bytes([32])
    counts = np.zeros(langid.BUCKETS)
    for n in (2, 3):
        for i in range(len(folded) - n + 1):
            gram = folded[i : i + n]
            code = gram[0] | gram[1] << 8 | ((gram[2] << 16 | 1 << 24) if n == 3 else 0)
            if gram not in (b"  ", b"   "):
                counts[(code * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    assert langid.features(text) == pytest.approx(np.sqrt(counts / counts.sum()), abs=1e-6)


def words_taken(rows, m):
    """Words the mix takes of each document, slot by slot and word by word."""
    taken, report = defaultdict(int), {}
    by = defaultdict(list)
    for d, text, _, source, *_ in rows:
        by[source].append((d, len(re.findall(WORD, text or ""))))
    for s in m.sources:
        stream = [d for d, n in sorted(by[s.name]) for _ in range(n)]
        assert len(stream) == s.size
        drawn = 0
        for _, source, first, slots in mixing.draw_shards([x.quota for x in m.sources], 17):
            if source == s.number:
                assert first == drawn
                drawn += slots
        assert drawn == s.quota
        for slot in range(s.quota):
            block = int(mixing.permuted(np.array([slot % s.blocks]), s.blocks, 17 + s.number)[0])
            for d in stream[block * s.words : (block + 1) * s.words]:
                taken[d] += 1
        for d, n in by[s.name]:
            report[d] = (n, s.size, taken[d])
    return report


def shares(sizes):
    """Targets by giving out the total in small steps would be slow; so by trying which sources stop."""
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    weight, total, stopped = {n: 1 + i % 3 for i, n in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rate = (total - sum(3 * sizes[n] for n in stopped)) / sum(weight[n] for n in names if n not in stopped)
        over = {n for n in names if n not in stopped and rate * weight[n] > 3 * sizes[n]}
        if not over:
            return {n: 3 * sizes[n] if n in stopped else rate * weight[n] for n in names}
        stopped |= over


def test_op3(spark, folder, docs, rows):
    got = {r["doc_id"]: r for r in run(spark, folder, "op3_mixing")}
    assert {d: (r["size"], r["source_size"], r["taken"]) for d, r in got.items()} == words_taken(rows, mixing.mix(docs))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(WORD, r[1] or ""))
    wanted = shares(sizes)
    assert all(got[r[0]]["target"] == pytest.approx(wanted[r[3]]) for r in rows)


def walk(tree, row):
    """A tree from its root down, a step at a time."""
    at, inner = 0, len(tree.feature)
    while at < inner:
        at = 2 * at + 1 + (row[tree.feature[at]] > tree.edge[at])
    return tree.value[at - inner]


def test_op4(spark, folder, docs, rows):
    got = {r["doc_id"]: r for r in run(spark, folder, "op4_toxicity")}
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), queries.fold(queries.F.col("doc_id"), 5) != 0)
    assert model.trees and set(got) == {r[0] for r in rows}
    xs, ys = model.knots
    for d, text, *_ in rows:
        row = toxicity.features(text, model.lexicon)
        raw = model.start + sum(walk(t, row) for t in model.trees)
        plain = 1 / (1 + np.exp(-raw))
        score = plain
        if len(xs):  # on the line between the knots about the raw score
            k = int(np.searchsorted(xs, raw, "right"))
            own = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k - 1] + (ys[k] - ys[k - 1]) * (raw - xs[k - 1]) / (xs[k] - xs[k - 1])
            score = min(1, max(0, 0.999 * own + 0.001 * plain))
        assert got[d]["score"] == pytest.approx(score, abs=1e-9)
        assert got[d]["predicted"] == (got[d]["score"] >= 0.5) and got[d]["held_out"] == (remainder(d, 5) == 0)


def test_isotonic_is_the_nearest_rising_fit():
    """Pooling against the max-min formula, without the slight pull of each pool to one half."""
    rng = np.random.default_rng(0)
    s, y = np.sort(rng.normal(size=40)), (rng.random(40) < np.linspace(0.1, 0.9, 40)).astype(float)
    xs, ys = toxicity.isotonic(s, y)
    for i, x in enumerate(s):
        fit = max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1))
        assert np.interp(x, xs, ys) == pytest.approx(fit, abs=0.05)


def test_op5(spark, folder, rows):
    wanted = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in words_removed(rows, 20).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, folder, "op5_substring_dedup")} == wanted


def test_op9(spark, folder, rows):
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, folder, "op9_suffix_dedup")} == bytes_removed(rows, 200)


def test_op6(spark, folder, rows):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["op6_exact_dedup"]).fetchall()
    assert sorted(tuple(r) for r in run(spark, folder, "op6_exact_dedup")) == sorted(wanted)


def test_op7(spark, folder):
    got = defaultdict(list)
    for r in sorted(run(spark, folder, "op7_ann"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x, hit = np.array([r["embedding"] for r in rows]), 0
    assert sorted(got) == list(range(0, 300, 20)) and all(len(v) == 20 for v in got.values())
    for q, found in got.items():
        scores = (x * x[q]).sum(1)
        assert found == sorted(((i, scores[i]) for i, _ in found), key=lambda p: (-p[1], p[0])) and q not in dict(found)
        scores[q] = -np.inf
        hit += len(set(np.argsort(-scores)[:20].tolist()) & {i for i, _ in found})
    assert hit >= 0.9 * 20 * len(got)


def test_op10(spark, folder, rows):
    prints = {r[0]: by_hand(r[1]) for r in rows}
    roots = linked(prints, 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op10_simhash")} == {d: (f"{prints[d]:016x}", roots[d]) for d in prints}
