import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, twin int, n int, bits string, toxicity string, kept string"
LONG = " ".join(f"word{k % 977} filler{k % 31}" for k in range(60_000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=90):
    """Words that are never the same for two seeds."""
    return " ".join(f"{WORDS[(seed * 7 + k * k) % 24]}{seed}x{k}" for k in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    base = prose(1)
    rows = [
        (1, base),
        (2, base),
        (2, base),
        (2, prose(2)),
        (3, None),
        (4, ""),
        (None, prose(3)),
        (None, None),
        (5, LONG),
        (6, LONG + " tail"),
        (7, "one"),
        (8, "\n\n \n"),
        (9, "first line here\nsecond line here\n\nthird\nfirst line here\nsecond line here"),
        (10, base.replace("x3 ", "y3 ")),
    ]
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "a", 1, None, "b", "c", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
