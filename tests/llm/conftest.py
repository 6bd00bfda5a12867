import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, a null id, null languages, and a clashing column."""
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in rng.integers(0, 3000, 30_000)]
    base = " ".join(words[:200])
    near = " ".join([*words[:100], "changed", *words[101:200]])
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, base), (5, base), (5, base), (6, near), (7, base.upper()),
        (8, "one two three"), (9, "One  two\tthree"), (10, "x"), (11, " ".join(words)), (12, " ".join(words) + " end"), (None, base), (None, None),
        (13, "é ü ß 日本語 🙂 <|endoftext|> don't"), (14, "spam " * 400), (15, "a b c d e"), (16, "12 34 !!! ..."),
    ]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", "s", 1, "clash") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
