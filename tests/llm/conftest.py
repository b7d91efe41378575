import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies and repeated rows, with extra columns of clashing names."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(vocab, k=rng.randint(1, 120)))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 3}", len(text), "x", 1.0))
    for i in range(120, 140):
        rows.append((i, rows[3][1], "en", "s0", 1, None, None))
    for i in range(140, 160):
        words = rows[7][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), None, None, None, None, None))
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s1", 0, "y", 0.0), (202, " \n\t ", None, "s1", 3, "y", 0.0), (203, "12 !! 34", "en", "s2", 8, "y", 0.0)]
    rows += [(None, "lost id", "en", "s1", 7, None, None), (204, "Long " * 30_000, "en", "s0", 150_000, None, None), (205, "ab" * 20_000, "de", "s0", 40_000, None, None)]
    rows += [rows[5], rows[5], (206, "Ünïcode Straße é 日本語 \U0001f600 <|endoftext|>", "de", "s2", 10, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
