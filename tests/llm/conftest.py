import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n int, key string, secrets string, component string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def frame(spark, texts, first=0):
    """Documents with extra columns whose names operators use inside."""
    rows = [(first + i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t), "x", 1, "k", "s", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, blanks, one-worders, repeats, many bytes per letter, a very long text."""
    rng = random.Random(0)
    return [None, "", "   \n\t ", "one", "one", "é" * 500, "日本語 " * 300, "z" * 5000, words(rng, 60_000), "x\x00y | z", None]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
