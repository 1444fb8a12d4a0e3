import random

import pytest

WORDS = "the of and river stone walks under bright silent morning house table green letter winter garden".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ly"]) for _ in range(words))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    long = prose(99, 30_000)
    rows = [
        (1, prose(1, 60), "s0"), (2, None, "s0"), (3, "", None), (4, " \t\n", "s1"), (5, long, "s1"), (6, "one two", None),
        (7, prose(1, 60), "s0"), (8, prose(1, 60) + " extra", "s0"), (9, "x" * 5000, "s1"), (10, "é中 \U0001f600 don't", "s1"),
        (11, prose(3, 40), "s2"), (11, prose(3, 40), "s2"),
    ]
    kept = [(i, t, "en", s, len(t or ""), 0.5, 1, "k", 7) for i, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, key string, component_id long"
    return spark.createDataFrame(kept, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
