import random

import pytest

#: Rows that any operator over documents must live with: null ids and texts, empty and long ones, repeated rows.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s1", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s2", 0), (None, "some text here", "en", None, 3),
    (None, None, None, None, None), (4, "x", "en", "", 1), (5, "lang " * 30_000, "en", "s1", 5), (6, "word\x00and\tcontrols\r\n\x0b", "en", "s3", 6), (7, "ünïcödé 漢字 текст " * 5, "de", "s3", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("n", "key", "size", "node", "bucket", "label", "keys", "score", "words", "hash", "path", "blob", "spans"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sentence(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]
