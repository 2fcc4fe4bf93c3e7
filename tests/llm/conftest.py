"""Small corpora with everything that operators have to stand: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

CLASHING = ["kept", "shard", "n", "id", "run", "size", "score", "u", "v", "token", "group_size", "sha", "part", "slot", "live", "spans", "curve", "ids", "label", "component_id"]


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) if rng.random() < 0.5 else f"w{rng.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows (doc_id, text, lang, source) and many columns whose names the operators use inside."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(8)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20 + i, base[0], None, None) for i in range(12)]
    rows += [(40 + i, base[1].replace(" ", "\n", 3) if i % 2 else base[1].upper(), "fr", "s1") for i in range(4)]
    rows += [(50, None, None, "s1"), (51, "", "en", None), (52, " \n\t ", "en", "s1"), (53, "one two", "en", "s2"), (54, "One  TWO", "de", "s2"), (55, "é ß İ 日本 \U0001f600", "de", "s2")]
    rows += [(None, base[2], "en", "s1"), (None, "only here", "en", "s1"), (None, None, None, None)]
    rows += [(60, base[3], "en", "s1"), (60, base[3], "en", "s1"), (61, base[4], "en", "s1"), (61, base[5] + " end", "en", "s1")]
    rows += [(70, prose(rng, 30_000), "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
