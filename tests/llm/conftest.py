import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, anchor string, units string"


def corpus(seed: int = 3, n: int = 120) -> list[tuple]:
    """Rows with nulls in any column, empty and long texts, copies, near copies, shared passages, repeats inside a text, and ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, texts = sentence(60), []
    for i in range(n):
        t = sentence(rng.choice([1, 3, 5, 19, 20, 21, 60, 150]))
        if i % 7 == 0:
            t += " " + passage
        if i % 11 == 0 and texts:
            t = rng.choice(texts)
        if i % 13 == 0 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        texts.append(t)
    texts += ["", " \n\t ", "x", "Ab ab AB " * 40, "a" * 900, "zu " * 700, "One.\n\nTwo;  three", "One. Two; three", "<|endoftext|> it's <|startoftext|>x", "é" * 300, sentence(9000), "12 34 !!"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", "c", None, "hot", "hot"]), len(t), "s", None, "u") for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None, None, None, None), (len(rows) + 1, None, "en", "a", None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """A null doc_id, and one row three times."""
    text = " ".join(f"w{i}" for i in range(40))
    return spark.createDataFrame([(None, text, None, None, None, None, None, None)] + [(5, text, None, "a", None, None, None, None)] * 3 + [(6, text + " end", None, "a", None, None, None, None)], SCHEMA)
