"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, whole_row

#: Labelled documents that are learned from, at most, and words of the lexicon, at most.
FIT_DOCS, LEXICON = 12_000, 300
#: A lexicon word is this much more frequent among toxic documents, and in this share of them at least.
LEXICON_LIFT, LEXICON_SHARE = 8.0, 0.01
TREES, DEPTH, RATE, LEAST_LEAF, BINS, SHRINK = 80, 3, 0.15, 20, 64, 1.0
#: Words before and after a lexicon word in which a second person counts as near.
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes tú ti tuyo vosotros".split())
NAMES = ("lexicon density", "lexicon weight density", "lexicon words", "distinct lexicon words", "strongest word", "obfuscated lexicon words", "second person near", "second person density", "capitals", "shouted words", "exclamation", "punctuation", "obfuscated words", "log words")

_WORD = re.compile(r"[^\W_]+(?:[0-9@$*!][^\W_]+|[^\W_])*")
_INSIDE = re.compile(r"[^\W\d_][0-9@$*!]+[^\W\d_]")
_LEET = str.maketrans("013457@$!", "oieastasi")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a whole text; all zeros for an empty one."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    at = [i for i, w in enumerate(words) if w in lexicon]
    odd = [i for i, w in enumerate(words) if not w.isalpha() and _INSIDE.search(w)]
    hidden = [i for i in odd if words[i].translate(_LEET) in lexicon and words[i] not in lexicon]
    found = [words[i] for i in at] + [words[i].translate(_LEET) for i in hidden]
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if persons and found:
        where = np.array(persons)
        for i in at + hidden:
            k = np.searchsorted(where, i - NEAR)
            near += k < len(where) and where[k] <= i + NEAR
    chars, capitals = len(text), sum(map(str.isupper, text))
    marks = sum(map(text.count, "!?.,;:*#%&$@"))
    weights = [lexicon[w] for w in found]
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    return [len(found) / n, sum(weights) / n, float(len(found)), float(len(set(found))), max(weights, default=0.0), len(hidden) / n, near / n, len(persons) / n, capitals / chars, shouted / n, text.count("!") / chars, marks / chars, len(odd) / n, float(np.log1p(n))]


# --- trees ---


@dataclass
class Tree:
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray  # of the leaves

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (rows[np.arange(len(rows)), self.feature[at]] > self.edge[at])
        return self.value[at - (2**DEPTH - 1)]


def grow(rows, binned, edges, slope, curve) -> Tree:
    """A tree of fixed depth on binned features that gains most by second-order gains; a node without gain sends all rows left."""
    inner = 2**DEPTH - 1
    feature, edge, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    at = np.zeros(len(rows), np.int64)
    for node in range(inner):
        own = np.flatnonzero(at == node)
        best = 1e-9
        g, h = slope[own].sum(), curve[own].sum()
        for f in range(rows.shape[1] if len(own) >= 2 * LEAST_LEAF else 0):
            b = binned[own, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=BINS))[:-1] for w in (slope[own], curve[own], np.ones(len(own))))
            gain = gl**2 / (hl + SHRINK) + (g - gl) ** 2 / (h - hl + SHRINK) - g**2 / (h + SHRINK)
            gain[(nl < LEAST_LEAF) | (len(own) - nl < LEAST_LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best and k < len(edges[f]):
                best, feature[node], edge[node] = gain[k], f, edges[f][k]
        at[own] = 2 * node + 1 + (rows[own, feature[node]] > edge[node])
    for leaf in range(inner + 1):
        own = at == inner + leaf
        value[leaf] = -RATE * slope[own].sum() / (curve[own].sum() + SHRINK)
    return Tree(feature, edge, value)


def boost(rows: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(rows.shape[1])]
    for f, e in enumerate(edges):  # mostly zero features: edges among the others too
        if len(other := rows[rows[:, f] != 0, f]):
            edges[f] = np.unique(np.concatenate([e, [0.0], np.quantile(other, np.linspace(0, 1, BINS // 2)[1:-1])]))[: BINS - 1]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(rows, binned, edges, p - y, p * (1 - p)))
        score += trees[-1](rows)
    return start, trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (scores, rising shares of label 1) by pooling neighbours that fall."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # label sum, rows, least and greatest score
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        pools.append([t, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, pools[-1][2], hi]
    xs = np.array([x for p in pools for x in (p[2], p[3])])
    ys = np.repeat([(p[0] + 0.05) / (p[1] + 0.1) for p in pools], 2)
    return xs, np.maximum.accumulate(ys)


@dataclass
class Model:
    lexicon: dict[str, float]
    start: float
    trees: list[Tree]
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.start + sum((t(rows) for t in self.trees), np.zeros(len(rows)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the uncalibrated one orders texts within a step."""
        raw = self.raw(np.array([features(t, self.lexicon) for t in texts], float).reshape(len(texts), -1))
        plain = 1 / (1 + np.exp(-raw))
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * plain, 0, 1) if len(self.knots[0]) else plain


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            words = sorted({w for w in words_of(text or "") if len(w) < 40})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([label] * len(words), pa.int32())], ["word", "label"])


def _rows(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(features(t, lexicon)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = FIT_DOCS) -> Model:
    """Learn lexicon, trees and calibration from at most ``most`` labelled documents, taken by a hash of doc_id.

    ``learn`` is a condition on doc_id. A document labelled more than once is toxic if any label says so. Three quarters of the documents
    grow the lexicon and the trees; the rest calibrate them. Without both labels the model is constant.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.filter("doc_id is not null and toxic in (0, 1)")
    marks = (marks if learn is None else marks.filter(learn)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    texts = documents(docs)
    have = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = have.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = texts.join(F.broadcast(chosen), "doc_id").withColumn("grows", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0).persist()
    try:
        sizes = {r["label"]: r["count"] for r in sample.filter("grows").groupBy("label").count().collect()}
        if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
            return Model({}, -4.0 if sizes.get(0) or not sizes else 4.0, [], (np.zeros(0), np.zeros(0)))
        counts = sample.filter("grows").select("label", "text").mapInArrow(_words, "word string, label int").groupBy("word").agg(F.sum(F.col("label")).alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        bad, good = (F.col("bad") + 0.5) / (sizes[1] + 1), (F.col("good") + 0.5) / (sizes[0] + 1)
        lift = F.log(bad / good)
        picked = counts.filter((F.col("bad") >= max(3, LEXICON_SHARE * sizes[1])) & (bad / good > LEXICON_LIFT)).orderBy(F.desc("bad"), "word").limit(LEXICON).select("word", lift.alias("lift")).collect()
        lexicon = {r["word"]: float(r["lift"]) for r in picked}
        taken = sample.select("doc_id", "label", "text", "grows").mapInArrow(_rows(lexicon), "doc_id long, label int, features binary").join(sample.select("doc_id", "grows").distinct(), "doc_id").orderBy("doc_id").toArrow()
    finally:
        sample.unpersist()
    rows = np.frombuffer(b"".join(taken.column("features").to_pylist()), float).reshape(-1, len(NAMES))
    y, grows = taken.column("label").to_numpy().astype(float), taken.column("grows").to_numpy().astype(bool)
    start, trees = boost(rows[grows], y[grows])
    model = Model(lexicon, start, trees, (np.zeros(0), np.zeros(0)))
    if 0 < y[~grows].sum() < (~grows).sum():
        model.knots = isotonic(model.raw(rows[~grows]), y[~grows])
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                score = model.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def _clean(model, names: list[str]):
    """Whole rows of a score under one half."""
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.column("row").slice(lo, 128)
                kept = part.filter(pa.array(model.value.score(part.field(at).to_pylist()) < 0.5))
                yield pa.RecordBatch.from_arrays(kept.flatten(), names)

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row's whole text.

    score is the calibrated probability of label 1, predicted 1 from one half on. A null or empty text has features of
    zero and their score; a text of any length is read whole. Rows that repeat a doc_id, or have none, are scored each for itself. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return documents(docs).mapInArrow(_score(shared), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` predicted 0, with all their columns, whose names may be any.

    A null or empty text has features of zero and their score. Rows that repeat are judged each for itself. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(whole_row(docs)[0].alias("row")).mapInArrow(_clean(shared, docs.columns), docs.schema)
