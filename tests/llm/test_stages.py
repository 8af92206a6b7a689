"""The operators that return rows of documents: clashing names, repeated rows, nulls, and what is dropped, against brute force."""

import re
from collections import defaultdict

import pytest

from binaxis.llm import bloom, exact_dedup, mixing, simhash, toxicity

#: Names that the operators use themselves, and names that must be quoted.
CLASHING = ["_row", "_turn", "_plans", "_key", "_digest_of", "_digest", "_id", "_keep", "_learn", "row", "key", "digest", "maybe", "order", "row_key", "place", "print", "blocks", "a.b", "c`d"]


@pytest.fixture(scope="module")
def clashing(spark, rows):
    schema = "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASHING)
    return spark.createDataFrame([(r[0], r[1], r[3], r[4], *(f"{c}{r[0]}" for c in CLASHING)) for r in rows], schema).repartition(3)


def own_columns(row):
    return all(row[c] == f"{c}{row['doc_id']}" for c in CLASHING)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_keeps_columns(clashing, rows):
    got = exact_dedup.drop_exact(clashing)
    assert got.columns == clashing.columns
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(normal(r[1]), r[0])
    out = got.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(first.values()) and all(map(own_columns, out))


def test_near_keeps_columns(clashing):
    got = simhash.drop_near(clashing)
    assert got.columns == clashing.columns
    out = got.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in simhash.near_groups(clashing).collect() if r["doc_id"] == r["component_id"])
    assert all(map(own_columns, out))


def test_mix_keeps_columns(clashing):
    got = mixing.mix_documents(clashing)
    assert got.columns == clashing.columns
    words = defaultdict(int)
    for r in got.collect():
        assert own_columns(r)
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {r["doc_id"]: r["taken"] for r in mixing.mix_report(clashing).collect() if r["taken"]}


def test_toxic_keeps_columns(spark, clashing):
    model = toxicity.train(clashing, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.drop_toxic(clashing, model)
    assert got.columns == clashing.columns and sorted(map(str, got.collect())) == sorted(map(str, clashing.collect()))


SCHEMA = "doc_id long, text string, source string, lang string"


def test_exact_rows_that_repeat(spark):
    rows = [(5, "a b", None, "x"), (5, "a  b", None, "x"), (2, "a\tb", "s", None), (None, "a b", None, None), (None, "c", None, "y"), (None, "c", None, "x"), (None, "d", None, None), (7, None, None, None), (8, "", None, None), (9, "e", "s", "q"), (9, "e", "s", "p"), (9, "f", "s", "p")]
    got = exact_dedup.drop_exact(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    wanted = [(2, "a\tb", "s", None), (None, "c", None, "x"), (None, "d", None, None), (7, None, None, None), (9, "e", "s", "p"), (9, "f", "s", "p")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


def test_near_rows_that_repeat(spark):
    """Null and repeated doc_ids: the row that goes is told by all its columns."""
    import random

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    a, b, c, d = texts
    rows = [(5, a, None, "x"), (5, b, None, "x"), (2, a.upper(), None, None), (None, c, None, None), (None, d, None, None), (5, b, None, "x"), (5, b, None, "w"), (None, c, None, "z")]
    got = simhash.drop_near(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["2", "5", "None", "None"]
    assert {r["text"].lower() for r in got} == {t.lower() for t in texts}


def test_mix_rows_that_repeat(spark):
    rows = [(1, "one two three", "s", "x")] * 4 + [(1, "one two three", "s", "y"), (None, "four", None, None), (None, "four", None, None), (2, None, "s", None), (3, " \n", "t", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report, got = mixing.mix_report(docs).collect(), mixing.mix_documents(docs).collect()
    assert len(report) == len(rows)
    assert sum(len(r["text"].split()) for r in got) == sum(r["taken"] for r in report)
    assert sum(r["taken"] for r in report if r["doc_id"] is None) == sum(len(r["text"].split()) for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("op", [exact_dedup.drop_exact, simhash.drop_near, mixing.mix_documents])
def test_no_rows(nothing, op):
    got = op(nothing)
    assert got.columns == nothing.columns and got.count() == 0


def test_small_filters_change_nothing(clashing, monkeypatch):
    wanted = [sorted(map(str, f(clashing).collect())) for f in (exact_dedup.drop_exact, simhash.drop_near)]
    for name in ("LEAST_BITS", "MOST_BITS"):
        monkeypatch.setattr(bloom, name, 128)
    assert [sorted(map(str, f(clashing).collect())) for f in (exact_dedup.drop_exact, simhash.drop_near)] == wanted
