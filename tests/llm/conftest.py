from __future__ import annotations

import random

import pytest

EXTRA = ["id", "key", "n", "a", "b", "comp", "_text", "_id", "doc", "item", "words", "start", "_blob", "_spans", "_group", "shard", "score", "kept", "f1", "sh", "n_words"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    rng = random.Random(7)
    base = sentence(rng, 120)
    texts = [None, "", " \t\n", "one", "two words", base, base, base + " tail", base.upper(), sentence(rng, 30_000), "x" * 200_000, "\x1c\x85  odd blanks İß ﬁ 中文 🙂", "<|endoftext|> special", "line\n" * 40]
    docs = [(i, t, "en" if i % 3 else None, "src" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[5], docs[5], docs[0], (None, base, None, None, None), (None, None, None, None, None), (10**12, base, "de", "s", 1)]
    rows = [(*r, *[f"e{j}" for j in range(len(EXTRA))]) for r in docs]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA))


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(14)] + [(None, 1, 1), (3, None, None), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
