from __future__ import annotations

import random

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score string, N_WORDS int, component_id binary, label string"


def words(n, seed, kinds=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, equal rows, clashing columns."""
    from weftspan.llm._shared import prepare

    prepare(spark)
    long_ = words(60_000, 1, 5000)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (None, "some text of nobody here", "en", "a"), (3, " \t\n\x0b", "en", "b"), (4, long_, "en", "b"), (5, "x" * 200_000, None, "b"), (6, "twice the same row and text", "fr", "c"), (6, "twice the same row and text", "fr", "c"),
        (7, "MIT License é 1+1=2 a@b.example <|endoftext|>", "en", None), (8, "+1 (425) 555-9684\n" * 40, "en", "c"), (9, "a", "en", "c"), (None, None, None, None), (10, long_ + " more", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, g, s, None, "clash", 1, b"", "z") for i, t, g, s in rows], SHAPE)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.where("doc_id < -5")


def small(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
