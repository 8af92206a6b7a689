"""Language identification with error-correcting output codes over hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

#: Buckets of n-grams; documents of a language, and of all, that classifiers are fitted on, at most (but one of each language).
BUCKETS, FIT_DOCS, FIT_DOCS_IN_ALL = 4096, 600, 6000
#: Languages up to which the code has every split of them, and bits per doubling of languages beyond.
ALL_SPLITS, BITS_PER_DOUBLING = 6, 12
ROUNDS, RATE, SHRINK = 250, 0.5, 1e-5
#: Difference of the two best probabilities under which a prediction is ambiguous.
CLEAR = 0.2
UNKNOWN = "und"

#: Letters stay, other ASCII becomes a space.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams and trigrams of the lower-cased text."""
    b = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    b = np.concatenate([[np.uint32(32)], b, [np.uint32(32)]]).astype(np.uint32)
    two = b[:-1] | (b[1:] << np.uint32(8))
    three = two[:-1] | (b[2:] << np.uint32(16)) | np.uint32(1 << 24)
    counts = np.zeros(BUCKETS)
    for grams, blank in ((two, 0x2020), (three, 0x01202020)):
        at = (grams[grams != blank] * np.uint32(2654435761)) >> np.uint32(32 - 12)
        counts += np.bincount(at, minlength=BUCKETS)
    return np.sqrt(counts / max(1.0, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 per language; rows differ in many places."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= ALL_SPLITS:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if i == 0 else 1 - 2 * ((s >> (i - 1)) & 1) for s in splits] for i in range(n)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, BITS_PER_DOUBLING * math.ceil(math.log2(n))))
        code = code[:, np.abs(code.astype(int).sum(0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, in decoding

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages: of the loss that a row's margins have with each codeword, weighted by bit."""
        margins = rows @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.trust).sum(1) for word in self.code], axis=1)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        return odds / odds.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        if at:
            odds = self.decode(np.stack([features(texts[i]) for i in at]))
            order = np.argsort(-odds, axis=1, kind="stable")
            for i, row, best in zip(at, odds, order.tolist()):
                second = row[best[1]] if len(best) > 1 else 0.0
                out[i] = (self.languages[best[0]], float(row[best[0]]), bool(row[best[0]] - second < CLEAR))
        return out


def fit(rows: np.ndarray, langs: list[str]) -> Model:
    """One logistic classifier per bit of the code, over all rows at once, with momentum."""
    names = sorted(set(langs))
    code = codewords(len(names))
    of = np.array([names.index(x) for x in langs], np.int64)
    bits = code.shape[1]
    if not bits:
        return Model(names, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    share = (1.0 / np.bincount(of, minlength=len(names)))[of][:, None] / len(names)  # languages weigh the same
    y = code[of].astype(np.float32)
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    mw, mb, vw, vb = np.zeros_like(w), np.zeros_like(b), np.zeros_like(w), np.zeros_like(b)
    for t in range(1, ROUNDS + 1):
        slope = (-y / (1 + np.exp(y * (rows @ w + b))) * share).astype(np.float32)
        gw, gb = rows.T @ slope + SHRINK * w, slope.sum(0)
        for m, v, g, x in ((mw, vw, gw, w), (mb, vb, gb, b)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = ((rows @ w + b) * y > 0).mean(0)
    return Model(names, code, w, b, (right / right.sum() * bits).astype(np.float32))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = [features(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(rows, pa.binary())], ["lang", "features"])


def _chosen(rows: DataFrame, most: int, in_all: int) -> DataFrame:
    """(doc_id, lang): at most ``most`` documents of each language, and about ``in_all`` of all, those of the least hashes of doc_id.

    Hashes are spread evenly, so a bound on the hash, a little above what is needed, leaves few rows of each language however many there are;
    only these are numbered. It fails to leave enough once in very many times, and then a language has fewer rows.
    """
    spread = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    own = rows.select("doc_id", "lang", spread.alias("_at")).distinct()
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("_size"))
    languages = sizes.agg(F.count(F.lit(1))).scalar()
    share = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(in_all) / languages)))
    bound = (F.col("_share") + 8 * F.sqrt("_share") + 8) / F.col("_size")
    few = own.join(sizes.select("lang", "_size", share.alias("_share")), "lang").filter(F.col("_at") < bound)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_at", "doc_id"))).filter(F.col("_n") <= F.col("_share")).select("doc_id", "lang")


def train(docs: DataFrame, learn: Column | None = None, most: int = FIT_DOCS, in_all: int = FIT_DOCS_IN_ALL) -> Model:
    """Fit on at most ``most`` documents of each language and about ``in_all`` of all, taken by a hash of doc_id among those that ``learn`` admits.

    Rows without doc_id, language or text are not learned from; rows that repeat doc_id and language all are, if their document is
    taken. Without rows the model knows no language.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.filter("learn and lang is not null and text is not null and doc_id is not null").drop("learn")
    chosen = _chosen(rows, most, in_all)  # about in_all rows, so they may travel
    taken = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text").mapInArrow(_features, "lang string, features binary").toArrow()
    if not taken.num_rows:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    pairs = sorted(zip(taken.column("lang").to_pylist(), taken.column("features").to_pylist()))  # so that reruns agree
    return fit(np.frombuffer(b"".join(f for _, f in pairs), np.float32).reshape(-1, BUCKETS), [lang for lang, _ in pairs])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lang, score, unclear = zip(*model.value.predict(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row's whole text.

    A null or empty text, or one without a letter, is UNKNOWN with score 0; a text of any length is read whole. score is the decoded
    probability; ambiguous tells that a second language comes close. Of languages of one probability the first in code point order is told. Rows that
    repeat a doc_id, or have none, are judged each for itself. An empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return documents(docs).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, ambiguous boolean")
