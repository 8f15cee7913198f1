import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(200))
    near = base.replace(base.split()[100], "changed", 1)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, near, None, "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "de", "b"),
        (6, long, "en", "a"), (7, "the quick brown fox", "en", None), (7, "the quick brown fox", "en", None), (8, "une élève à Noël 😀", "fr", "c"),
        (None, "lost id here", "en", "a"), (9, "### $$$ %%%", "en", "b"), (10, "12345 67890", "en", "b"), (11, "line one\nline one\nline two", "en", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, __w string, id long, target string, n int, ids binary, part int, at double, h string, f0 int, vid int, rep int, score double, host string, media int"
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *[None] * 16) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
