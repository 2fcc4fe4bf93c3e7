"""Vector codes against a plain version in Python integers; the registered query has SQL, too."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstrata.llm import queries, vector_codes
from loomstrata.llm.common import read

COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
LONGEST = (1 << 63) - 1


def plain(rows: list[tuple], entries: int = 16, rounds: int = 6) -> list[tuple]:
    """rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    m = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    kept = [(i, v + [0] * (8 * m - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * m : p * m + m]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    near = lambda v, p: min((dist(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(8):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(mine[e]) for c in zip(*mine[e])] if mine[e] else old for e, old in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(8)), sum(min(near(v, p)[0], LONGEST) for p in range(8)), label) for i, v, label in kept]
    totals = defaultdict(int)
    for _, _, error, label in coded:
        totals[label] += error
    return sorted(((i, c, min(e, LONGEST), min(totals[label], LONGEST), sha) for i, c, e, label in coded), key=str)


def run(df) -> list[tuple]:
    return sorted((tuple(r) for r in vector_codes.digest(df).select(COLUMNS).collect()), key=str)


def test_registered(spark, data):
    rows = [tuple(r) for r in read(spark, data, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = queries.op12_vector_codes(spark, data)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("length", [8, 19, 0])
def test_odd_rows(spark, length):
    rng = random.Random(length)
    rows = [(rng.randint(0, 60), [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-9, 9)]) for _ in range(length)], rng.choice([None, 1, 2])) for _ in range(90)]
    rows += rows[:40] + [(500 + i, rows[0][1], 3) for i in range(50)]
    rows += [(1, None, 1), (2, [None] * length, 1) if length else (2, None, 1), (None, rows[1][1], None), (70, rows[2][1][: length // 2], None), (71, [], 1)]
    rows += [(80 + k, [1.0] * (length - 1) + [x], 1) for k, x in enumerate([float("nan"), float("inf"), float("-inf")])] if length else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    df = df.select("*", *(F.lit("x").alias(c) for c in ("id", "v", "part", "value", "row", "n", "run", "bare")))
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert run(df) == plain(floats)


def test_components_beyond_exact_doubles(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1.0, -3.0, 1e5, -7e11, 3e30, -2e38]) * rng.choice([1, 1.5]) for _ in range(16)], i % 2) for i in range(60)]
    rows += [(100 + i, [rng.uniform(-9, 9) for _ in range(16)], 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert run(df) == plain(rows)


def test_few_rows_strings_and_none(spark):
    few = spark.createDataFrame([("b", [0.5] * 8, "x"), ("a", [-0.5] * 8, None)], "vec_id string, embedding array<double>, label string")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.digest(few).collect()}
    assert got == {"a": ("00" * 8, 0, 0), "b": ("01" * 8, 0, 0)}
    assert vector_codes.digest(few.limit(0)).collect() == []


def test_reconstruct(spark, data):
    df = read(spark, data, "embeddings")
    out, books = vector_codes.compress(df)
    rows = {r.vec_id: r for r in out.collect()}
    for r in df.collect():
        near = vector_codes.reconstruct([rows[r.vec_id].code], books)[0] * 4096
        assert sum((math.floor(4096 * x) - int(y)) ** 2 for x, y in zip(r.embedding, near)) == rows[r.vec_id].error
