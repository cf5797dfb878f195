import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_tokens", LongType()), StructField("size", LongType())])
WORDS = [f"w{i}" for i in range(300)]


def corpus(seed: int = 0, n: int = 120) -> list[tuple]:
    """Random texts with exact and near copies, repeated lines, odd texts, and columns whose names clash."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n ", "one", "One", "one two three", "a b c d e f", "Ünï ëß 日本語 😀 <|endoftext|> x", "word " * 3000, "x" * 20000]
    while len(texts) < n:
        if rng.random() < 0.5 or len(texts) < 20:
            texts.append("\n".join(" ".join(rng.choices(WORDS, k=rng.randint(3, 40))) for _ in range(rng.randint(1, 5))))
        else:
            w = (rng.choice(texts[10:]) or "").split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s1", "s2", "S", None]), 7, 8) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here at all", "aa", "s2", 1, 1)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
