import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """A function (seed, words) -> text of invented words in sentences."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(["ka", "lo", "mi", "ten", "ur", "sa"]) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, schema="doc_id long, text string, lang string, source string, n_chars long, node string, h int"):
        return spark.createDataFrame([(i, t, "en", "s" if i % 3 else None, None if t is None else len(t), "clash", 1) for i, t in enumerate(texts)], schema)

    return make
