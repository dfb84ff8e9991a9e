import random

import pytest

#: Extra columns whose names operators use inside themselves.
SCHEMA = "doc_id long, text string, fingerprint string, fp long, key long, h long, bucket int, shard int, part int, block long, code long, rank long, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6, 7, 8, 9, None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(seed, n, words=200):
    rnd = random.Random(seed)
    table = ["".join(rnd.choice(["an", "be", "co", "du", "él", "fö", "gn", "he"]) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    return " ".join(rnd.choice(table) + rnd.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def corpus():
    """Distinct ids: copies, near copies, a passage that many share, empty, null, short, long and odd texts."""
    texts = [prose(s, 30 + 17 * s) for s in range(14)]
    near = texts[13].split(" ")
    near[7] = "changed"
    shared = prose(99, 60)
    texts += [texts[3], texts[3], texts[3].upper(), " ".join(near), prose(50, 80) + " " + shared, shared + " " + prose(51, 70), prose(52, 40) + " " + shared + " " + prose(53, 20)]
    texts += ["", None, "one", "one two", "a b c", "  \t\n ", "x " * 400, prose(70, 9000), "<|endoftext|> <|startoftext|>é", "日本語 テキスト " * 30, "## | ** " * 60, "line\n" * 70, "a　b\x1cc\x85 d", "word" * 3000]
    return list(enumerate(texts))


def awkward():
    """Null ids, repeated rows, and ids that several texts have."""
    a, b = prose(1, 90), prose(2, 120)
    return [(None, a), (None, None), (1, a), (1, a), (1, b), (2, None), (2, None), (3, ""), (4, b), (None, a)]


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, awkward())


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
