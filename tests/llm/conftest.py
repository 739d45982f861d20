import os
import random
import string
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, os.path.dirname(os.path.dirname(HERE)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """rows: (doc_id, text) -> a documents table."""
    def make(rows, extra="", values=()):
        full = [(i, t, "en", "s", None if t is None else len(t), *values) for i, t in rows]
        return spark.createDataFrame(full, DOCS + extra)
    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    pool = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(4000)]

    def some(n, seed):
        return random.Random(seed).choices(pool, k=n)
    return some


AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (None, "null id text here"), (7, "É ß 日本 語"),
           (8, "same same"), (8, "same same"), (9, "x" * 100_000), (10, "a b " * 30_000), (11, "\x00 nul")]
