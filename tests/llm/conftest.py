import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """Invented words, always the same."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a table of documents."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)

    return make


#: What any operator must take: nulls, empty and long texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (None, "a few words here"), (3, "one"), (3, "one"), (4, "x" * 200_000), (5, "of a long text " * 20_000), (6, "émoji 😀 ünï \u0000 ퟿ end"), (7, "a few words here"), (None, None)]


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture
def clashing(spark):
    """Columns with names that operators could use themselves."""
    names = ["_row", "_hash", "_key", "_own", "_text", "_label", "_doc", "_gone", "_first", "later", "fp", "root", "keys", "links", "text_of"]

    def add(df):
        from pyspark.sql import functions as F

        return df.select("*", *(F.lit(f"own {n}").alias(n) for n in names)), names

    return add


def schema(**kinds):
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])
