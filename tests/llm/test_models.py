"""Language identification, toxicity, mixing, nearest neighbours, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binaxis.llm import ann, langid, mixing, toxicity

WORDS = {"en": "the of and to in is that it was with by this".split(), "fr": "le la des une est que dans pour vous être".split(), "de": "der die und das ist nicht mit ein für über".split(), "es": "el los que una por con para más está".split(), "it": "il che di non per sono della questo più".split()}
TOXIC = ["idiot", "moron", "scum"]


def sentences(seed: int, n: int, langs=tuple(WORDS)) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = langs[i % len(langs)]
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 60))), lang, f"s{i % 3}", 0))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("langs", [("en",), ("en", "fr"), tuple(WORDS)])
def test_languages(spark, langs):
    rows = sentences(1, 200, langs) + [(900, None, "en", "a", 0), (901, "12 !? 3", "en", "a", 0), (902, "", None, None, None), (903, "the and of that", None, "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, most=50)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[d]["lang_pred"] for d in (900, 901, 902)} == {"und"}
    learned = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).collect()}
    held_out = [r for r in rows if r[0] not in learned and r[0] < 900]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held_out) >= 0.97 * len(held_out)


def test_languages_without_rows(spark, nothing, docs):
    model = langid.train(nothing)
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


@pytest.mark.parametrize("n", [2, 4, 6, 9, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= (1 if n == 2 else 4 if n > 3 else 2)


def test_close_calls_are_ambiguous(spark):
    docs = spark.createDataFrame(sentences(2, 300, ("en", "de")), SCHEMA)
    model = langid.train(docs)
    mixed = " ".join(WORDS["en"] + WORDS["de"])
    margin = abs(np.diff(np.sort(model.decode(langid.features(mixed)[None])[0]))[0])
    assert model.predict([mixed])[0][2] == (margin < langid.CLEAR)


def abusive(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    rng, docs, labels = random.Random(seed), [], []
    for i, (d, text, lang, source, _) in enumerate(sentences(seed, n)):
        bad = rng.random() < 0.3
        words = text.split()
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC).upper() if rng.random() < 0.3 else rng.choice(TOXIC))
        docs.append((d, " ".join(words), lang, source, 0))
        labels.append((d, 0, int(bad)))
    return docs, labels


def test_toxicity(spark):
    rows, marks = abusive(4, 600)
    docs = spark.createDataFrame(rows + [(9000, None, None, None, None), (9001, "", "en", "a", 0)], SCHEMA)
    labels = spark.createDataFrame(marks + [(1, None, None), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    assert set(TOXIC) <= set(model.lexicon)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held_out = [(got[d]["predicted"], y) for d, _, y in marks if d % 5 == 0]
    assert np.mean([p == y for p, y in held_out]) >= 0.95
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, r in got.items() if not r["predicted"])


def test_toxicity_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert {r["predicted"] for r in toxicity.scores(docs, model).collect()} == {0}
    assert toxicity.scores(nothing, model).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(-3, 3), st.integers(0, 1)), min_size=1, max_size=50))
def test_isotonic_rises(pairs):
    s, y = (np.array(c, float) for c in zip(*pairs))
    xs, ys = toxicity.isotonic(s, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


# --- mixing ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_shares(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    out = mixing.share_out(sizes, weights)
    assert sum(out) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(out, sizes))
    rates = {round(t / w, 6) for t, w, s in zip(out, weights, sizes) if t < 3 * s - 1e-6}
    assert len(rates) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_draws_take_each_quota():
    quotas, taken = [100, 0, 70_000, 13], Counter()
    for _, s, first, n in mixing.draw_shards(quotas, 1):
        assert first == taken[s]
        taken[s] += n
    assert [taken[i] for i in range(4)] == quotas


def size(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(docs, rows, nothing, odd):
    got = mixing.mix_report(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in rows)
    totals, taken, targets = Counter(), Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in rows:
        totals[r[3]] += size(r[1])
    names = sorted(n for n in totals if n is not None) + [None]
    wanted = dict(zip(names, mixing.share_out([totals[n] for n in names], [1, 2, 3, 1, 2, 3][: len(names)])))
    for r in got:
        assert r["source_size"] == totals[source[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        targets[source[r["doc_id"]]] = r["target"]
    assert targets == pytest.approx(wanted)
    assert all(abs(taken[n] - wanted[n]) <= 0.05 * wanted[n] + 3 * mixing.BLOCK_WORDS[0] for n in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    assert mixing.mix_report(nothing).count() == 0
    assert mixing.mix_report(odd).count() == 5


@pytest.mark.parametrize("sizes", [(1_000_000, 800_000, 2), (1_000_000, 800_000, 7), (1_000_000, 800_000, 17), (1_000_000, 800_000, 33), (5, 5, 5), (3000, 1, 90, 0), (50_000, 40, 7000)])
def test_small_sources_near_their_targets(sizes):
    for s in mixing.plan_sources({f"s{i}": n for i, n in enumerate(sizes)}):
        at = mixing.permuted(np.arange(s.quota) % s.blocks, s.blocks, 17 + s.number) if s.quota else np.zeros(0, np.int64)
        taken = int((np.minimum(s.size, (at + 1) * s.words) - at * s.words).sum())
        assert abs(taken - s.target) <= 0.5 + 0.02 * s.target
        assert taken <= 3 * s.size and (s.target < 3 * s.size or taken == s.target)


def test_small_sources_stay_in_the_mix(spark):
    rows = [(i, " ".join(["word"] * 400), None, "a" if i % 2 else "b", 0) for i in range(40)] + [(100, "two words", None, "c", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [(r["target"], r["taken"]) for r in mixing.mix_report(docs).collect() if r["doc_id"] == 100] == [(6.0, 6)]
    assert [r["text"] for r in mixing.mix_documents(docs).collect() if r["doc_id"] == 100] == ["two words"] * 3


def test_mixed_texts_hold_the_words_taken(docs, rows, odd, nothing):
    words, report = Counter(), {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({d: n for d, n in report.items() if n})
    taken = sum(r["taken"] for r in mixing.mix_report(odd).collect())
    assert sum(size(r["text"]) for r in mixing.mix_documents(odd).collect()) == taken
    assert mixing.mix_documents(nothing).count() == 0


# --- nearest neighbours ---


def vectors(n: int, d: int = 12, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=d))], 0) for i in range(n)]
    rows += [(n + k, rows[3][1], 0) for k in range(60)]  # one vector many times
    return rows + [(9000, None, 0), (9020, [0.0] * d, 0), (9040, [float("nan")] * d, 0), (9060, [1.0] * (d - 1) + [None], 0), (9080, [1.0, 2.0], 0), (None, [1.0] * d, 0)]


def exact(rows, top):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = (x * v).sum(1)
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:top]
            out[i] = [(int(ids[k]), s[k]) for k in order]
    return out


@pytest.mark.parametrize("part_rows", [7, 100, 10_000])
def test_neighbours_of_all_cells(spark, monkeypatch, part_rows):
    """Lists of several parts, parts of several lists, one part."""
    monkeypatch.setattr(ann, "PART_ROWS", part_rows)
    monkeypatch.setattr(ann, "RANKED_QUERIES", 10)
    rows = vectors(400)
    wanted = exact(rows, 20)
    got = defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for r in ann.neighbours(table, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}
    assert all(a == pytest.approx(b, rel=1e-12) for q in wanted for (_, a), (_, b) in zip(got[q], wanted[q]))


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_part_of_the_cells(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "PART_ROWS", 500)
    rows = vectors(3000, seed=1)
    if clustered:
        rng = np.random.default_rng(2)
        at = rng.normal(size=(30, 12)) * 5
        rows = [(i, [float(x) for x in np.float32(at[i % 30] + rng.normal(size=12) * 0.2)], 0) for i in range(3000)]
    wanted, found, visited, whole = exact(rows, 20), defaultdict(set), [], ann.rows_to_visit
    monkeypatch.setattr(ann, "rows_to_visit", lambda index, asked, books, counts, *a: visited.append((n := whole(index, asked, books, counts, *a)) / counts.sum()) or n)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for r in ann.neighbours(table, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = sum(len({i for i, _ in v} & found[q]) for q, v in wanted.items()) / sum(map(len, wanted.values()))
    assert recall >= 0.9
    assert visited[0] < (0.2 if clustered else 0.95)


def test_only_visited_cells_are_ranked(spark, monkeypatch):
    """What a query finds are the nearest rows of the cells that it visits, no more and no less."""
    held = {}

    def few(index, asked, books, counts, *_):
        held.update(books=books, counts=counts, rows=[(r["vec_id"], r["cell"], np.array(r["vec"])) for r in index.collect()])
        return 60

    monkeypatch.setattr(ann, "rows_to_visit", few)
    monkeypatch.setattr(ann, "PART_ROWS", 300)
    rows, found = vectors(2000, seed=3), defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for r in ann.neighbours(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    a, b = held["books"]
    for q, ids in found.items():
        own = np.array(next(v for i, v, _ in rows if i == q), float)
        visited = set(ann.cells_in_order(-own[:6] @ a.T, -own[6:] @ b.T, held["counts"], 60))
        near = sorted((-(v * own).sum(), i) for i, cell, v in held["rows"] if cell in visited and i != q)
        assert ids == [i for _, i in near[:20]]


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], "vec_id long, embedding array<float>, label int")
    got = ann.neighbours(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.neighbours(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_heap_order():
    rng = np.random.default_rng(0)
    a, b, counts = rng.normal(size=5), rng.normal(size=7), rng.integers(0, 4, 35)
    order = ann.cells_in_order(a, b, counts, 10**9)
    sums = [a[c // 7] + b[c % 7] for c in order]
    assert sorted(order) == list(range(35)) and all(x <= y + 1e-12 for x, y in zip(sums, sums[1:]))


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from binaxis.llm import exact_dedup, simhash

    rows, marks = abusive(7, 500)
    rows += [(1000 + i, r[1].replace(" ", "  "), r[2], r[3], 0) for i, r in enumerate(rows[:60])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = at[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
        own = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "exact_dedup":
            assert own == sorted(r["doc_id"] for r in exact_dedup.exact_groups(before).collect() if r["kept"])
        if name == "simhash_near_dedup":
            assert own == sorted(r["doc_id"] for r in simhash.near_groups(before).collect() if r["doc_id"] == r["component_id"])
    toxic = {d for d, _, y in marks if y}
    left = {r["doc_id"] for r in at["toxicity"].collect()}
    assert len(left & toxic) <= 0.05 * len(toxic) and len(left - toxic) >= 0.95 * (len(rows) - len(toxic) - 60)
    tokens_in = sum(len(p["ids"]) for p in at["packing"].collect()) // 4
    assert tokens_in == sum(p["length"] for p in at["packing"].collect()) > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at["packing"].count()
