import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies, odd characters."""
    rng = random.Random(7)
    base = [words(rng, 120) for _ in range(6)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    rows += [(10 + i, base[0], "en", "a", 1) for i in range(4)]
    for i in range(12):
        w = base[1].split()
        for _ in range(i // 4 + 1):
            w[rng.randrange(len(w))] = "changed"
        rows.append((20 + i, " ".join(w), None if i % 3 else "en", None, None))
    rows += [(40, None, "en", "a", 0), (41, "", "en", "a", 0), (42, "   \n\t ", "de", "a", 6), (43, "one two", "de", "b", 7), (44, "ONE two", "de", "b", 7), (45, words(rng, 9000), "en", "c", 5)]
    rows += [(46, "Ünïcode  ß \u3000 wörter\u00a0x\u2028y\x1cz 日本 🎉 <|endoftext|> don't 12345", "fr", "c", 1), (47, "same line\nsame line\n\nother\nsame line", "fr", "c", 1), (48, "a b " * 60, "fr", "c", 1), (48, "a b " * 60, "fr", "c", 1)]
    rows += [(None, "null key text with some words", "en", "c", 1), (None, None, None, None, None), (2, base[2], "en", "a", 1), (60, "x" * 5000, "en", "c", 1), (61, "#*$ %% tail ", "es", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
