"""Overlap scores as joins and counts against plain ones."""

from __future__ import annotations

import random

import pytest

from loomstrata.functions.overlap import stem
from loomstrata.operators import overlap

from . import plain_overlap as plain

SENSES = {"big": {"size"}, "large": {"size", "free"}, "car": {"vehicle"}, "cats": {"pet"}, "dog": {"pet"}}


def texts() -> list[tuple[str | None, str | None]]:
    rng = random.Random(3)
    words = "the The a cat cats running runs ran big large car dog it's x1 é, of nationally national 7 . -".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(some(rng.randint(0, 25)), some(rng.randint(0, 25))) for _ in range(120)]
    out += [(some(rng.randint(50, 300)), some(rng.randint(50, 300))) for _ in range(12)]
    out += [(t, t) for t in (some(61), some(62), some(63), some(124), some(125), "one", "two words")]
    return [*out, ("", ""), ("", "a b"), ("a b", ""), (None, "a"), ("a", None), (" a　b\x1cc ", "a b c"), ("word", "word"), ("word", "other")]


@pytest.mark.parametrize("senses", [None, SENSES])
def test_scores(spark, senses):
    rows = texts()
    df = spark.createDataFrame([(i, f"g{i % 3}", *r) for i, r in enumerate(rows)], "k long, g string, text string, reference string").repartition(5)
    got = {r.k: r for r in overlap.overlap_scores(df, ["g", "k"], "text", "reference", senses).collect()}
    assert len(got) == len(rows)
    for i, (a, b) in enumerate(rows):
        r = got[i]
        if a is None or b is None:
            assert (r.bleu4, r.rouge_l, r.meteor) == (None, None, None)
            continue
        assert r.bleu4 == pytest.approx(plain.bleu4(a, b)), (a, b)
        assert r.rouge_l == pytest.approx(plain.rouge_l(a, b)), (a, b)
        assert r.meteor == pytest.approx(plain.meteor(a, b, senses)), (a, b)


def test_known_values(spark):
    cases = [("the cats sat", "the cat sat"), ("the cat sat on the mat", "the cat sat on the mat"), ("a", "b"), ("x", "X")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k long, t string, r string")
    got = [tuple(r)[1:] for r in overlap.overlap_scores(df, ["k"], "t", "r").orderBy("k").collect()]
    assert got[0][1] == 1.0 and got[0][2] > 0.9
    assert got[1][:2] == (pytest.approx(1.0), 1.0) and got[2] == (0.0, 0.0, 0.0)
    assert got[3][0] == 0.0 and got[3][1] == 1.0 and got[3][2] == pytest.approx(0.5)
    assert [stem(w) for w in ("running", "nationally", "ties", "sky")] == ["run", "nation", "ti", "sky"]


def test_python_only_stems(spark):
    df = spark.createDataFrame([(1, "a", "b")], "k long, t string, r string")
    plan = overlap.bleu4(overlap._sides(df, ["k"], "t", "r", overlap.words), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
