from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, bucket int, shard int"


def rows_of(texts, start=0):
    """Documents with further columns whose names clash with the operators' own."""
    return [(start + i, t, "en" if i % 3 else "fr", f"src{i % 4}", len(t or ""), "own", "own", 7, 9) for i, t in enumerate(texts)]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empties, blanks, copies, near copies, shared lines and a very long text."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(3, 80)) for _ in range(30)]
    long_near = base[0].split() * 3 + words(rng, 200).split()
    near = " ".join(long_near[:150] + ["changed"] + long_near[151:])
    shared = [f"{b}\n  Shared LINE here \n{b[:9]}\n" for b in base[:12]]
    return [None, "", " \t\n ", "one", "two words", *base, *base[:4], " ".join(long_near), near, *shared, words(rng, 40_000, 3000), "Ünï çødé ΣΑΣ 日本 İ <|endoftext|> x", "a\r\nb\x0bc\x1cd"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = rows_of(texts)
    return spark.createDataFrame([*rows, rows[6]], SCHEMA).repartition(4)  # one row twice


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
