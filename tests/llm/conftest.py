import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("digest", "rep", "block", "kind", "bucket", "payload", "keep_id", "gid", "label", "spans", "items", "kept")


def corpus(seed: int = 5) -> list[tuple]:
    """Small documents with every awkward case: nulls, empty ones, ties, repeated rows, copies, a long one, other scripts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 7), (4, "one", "en", "a", 3), (5, "One two three four", "en", "a", 18),
        (6, "one two three four", "en", "a", 18), (7, "one  two three\tfour\n", "en", "a", 20), (8, "123 !!! ...", "de", "a", 11), (9, "日本語 テキスト である", "ja", "a", 12),
        (10, "under the MIT License, apache license version 2 CC BY-NC", "en", "a", 50), (11, "don't <|endoftext|> é́ ﬁ İstanbul ΣΑΣ", "en", "b", 40),
        (12, "x" * 3000, "en", "b", 3000),
    ]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (30, 60, 90)]
    for k in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + k, " ".join(w), rng.choice(["en", "de"]), "c", 1))
    rows.append((200, " ".join(rng.choice(words) for _ in range(20_000)), "en", "c", 1))
    rows += [rows[20], rows[20]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_ids(spark):
    """Rows without a doc_id."""
    return spark.createDataFrame([(None, "some words in a row", "en", None, None), (None, None, None, None, None), (7, "some words in a row", "en", None, None)], SCHEMA)
