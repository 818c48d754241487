import random

import pytest

LETTERS = str.maketrans("0123456789", "abcdefghij")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "a long, b long, id long, hash long, key string, root long, slot int, size int, part int, n int, words string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables: two shuffle partitions keep the many small jobs short."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="session")
def documents(spark):
    """(id, text) rows to a documents table; ``clashing`` adds columns with common names."""

    def make(rows, clashing=False):
        full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        schema = SCHEMA
        if clashing:
            full = [(*r, 1, 2, 3, 4, "k", 5, 6, 7, 8, 9, "w") for r in full]
            schema = f"{SCHEMA}, {CLASHING}"
        return spark.createDataFrame(full, schema)

    return make


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join("w" + str(r.randrange(vocabulary)).translate(LETTERS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    return [
        (None, None), (None, ""), (None, "a text without an id, twice"), (None, "a text without an id, twice"),
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "It's two"), (6, "It's two"),
        (7, long), (8, long + " end"), (9, prose(2, 200)), (9, prose(2, 200)), (10, prose(2, 200)),
        (11, "é́ ÄÖß 12 345 \x00\x01 　 <|endoftext|> don't"), (12, "a\n\nb\n" * 50), (13, "x" * 20_000),
    ]
