import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size int, key string, id bigint, token string, score string, label string, _id string, _text string, shard string"
)


def as_docs(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text, lang, source), with further columns of clashing names."""
    more = [None, "k", 5, "t", "s", "l", "i", "x", "h"]
    full = [(d, t, lang, s, len(t) if t else None, *more) for d, t, lang, s in rows]
    return spark.createDataFrame(full, schema)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, ties and junk."""
    rng = random.Random(5)
    base, passage = prose(rng, 200).split(), prose(rng, 60)
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(base), "en", "a"),  # copy
        (3, " ".join([*base[:50], "CHANGED", *base[51:]]), "en", None),  # near copies
        (4, " ".join([*base[:150], "other", *base[151:]]), "en", "b"),
        (5, " ".join(base).upper(), "en", "b"),
        (6, prose(rng, 40) + "\n" + passage + "\t" + prose(rng, 30), "fr", "c"),
        (7, passage + " " + prose(rng, 500), None, "c"),
        (8, "x y " * 300, "en", "a"),  # repeats itself
        (9, None, "en", "a"),
        (10, "", None, None),
        (11, " \t\n ", "de", "b"),
        (12, "one two three", "de", "b"),
        (13, "One TWO three", "de", "d"),
        (14, prose(rng, 30_000, 5000), "en", "a"),  # very long
        (15, "naïve café ÉTUDE " * 8, "fr", "é"),
        (16, "line a\nline a\n\nline b\nline a " + "#*$%&|<> " * 20, "en", "d"),
        (17, passage, "en", "a"),
        (18, "\x00zero\x1fbyte w" + "o" * 3000, "en", "b"),
    ]
    return rows + [(100 + i, prose(rng, rng.randrange(1, 120)), "en", rng.choice("abcd")) for i in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return as_docs(spark, odd_rows)


@pytest.fixture(scope="session")
def repeated_docs(spark, odd_rows):
    """The odd rows once more, rows with null ids, and an id that two texts share."""
    rng = random.Random(6)
    more = [(None, prose(rng, 50), "en", "a"), (None, None, None, None), (3, prose(rng, 50), "en", "a")]
    return as_docs(spark, odd_rows + odd_rows[:8] + more)


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_docs(spark, [])
