"""Platt's fit for all groups at once: closed forms, an independent search, groups without a maximum, scores by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest

from loomstrata.operators import judge


def loss(a: float, b: float, s: np.ndarray, y: np.ndarray) -> float:
    z = a * s + b
    return float((np.logaddexp(0, z) * y + np.logaddexp(0, -z) * (1 - y)).sum())


def searched(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The least loss by a grid that closes in."""
    a = b = 0.0
    width = 16.0
    while width > 1e-7:
        grid = [(a + i * width, b + j * width) for i in range(-4, 5) for j in range(-4, 5)]
        best = min(grid, key=lambda p: loss(*p, s, y))
        if best == (a, b):
            width /= 2
        a, b = best
    return a, b


def test_many_groups(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g, (a, b, n) in {"mild": (-2.0, 0.5, 200), "steep": (-9.0, 4.0, 150), "rising": (3.0, -1.0, 80), "few": (-1.0, 0.0, 12)}.items():
        s = rng.random(n).round(2)
        y = (rng.random(n) < 1 / (1 + np.exp(a * s + b))).astype(int)
        y[:2] = [0, 1]
        rows += [(g, float(x), int(v)) for x, v in zip(s, y)]
        want[g] = (*searched(s, y), s, y)
    rows += [(None, 0.2, 1), (None, 0.2, 0), (None, 0.2, 1), (None, 0.2, 1)]  # one confidence: b alone
    rows += [("apart", 0.1, 0), ("apart", 0.2, 0), ("apart", 0.8, 1), ("apart", 0.9, 1)]
    rows += [("three", 0.1, 0), ("three", 0.5, 1), ("three", 0.7, 1)] + [("all", k / 10, 1) for k in range(6)] + [("mild", None, 1), ("mild", 0.5, None)]
    got = {r.m: r for r in judge.calibration(spark.createDataFrame(rows, "m string, confidence double, correct int").repartition(5), ["m"]).collect()}
    for g, (a, b, s, y) in want.items():
        r = got[g]
        assert (r.a, r.b) == (pytest.approx(a, abs=1e-4), pytest.approx(b, abs=1e-4)), g
        p = 1 / (1 + np.exp(r.a * s + r.b))
        bins = np.minimum((p * 5).astype(int), 4)
        ece = sum(abs(p[bins == k].mean() - y[bins == k].mean()) * (bins == k).mean() for k in range(5) if (bins == k).any())
        assert (r.n, r.brier, r.ece, r.base_rate) == (len(s), pytest.approx(((p - y) ** 2).mean()), pytest.approx(ece), pytest.approx(y.mean()))
        assert r.skill == pytest.approx(1 - r.brier / (y.mean() * (1 - y.mean())))
    assert got[None].a * 0.2 + got[None].b == pytest.approx(-math.log(3))
    assert got["apart"].brier < 1e-6 and got["apart"].a < 0
    assert got["three"].a is None and got["all"].a is None and got["all"].skill is None


def test_far_from_the_start(spark):
    """A confidence on another scale, where plain Newton steps would overshoot: halved steps get there."""
    s, y = np.array([100.0, 101, 102, 103, 104, 105, 106, 107]), np.array([0, 0, 1, 0, 0, 1, 1, 1])
    counts = spark.createDataFrame([("g", float(x), int(v), 1 - int(v)) for x, v in zip(s, y)], "g string, confidence double, right int, wrong int")
    r = judge.platt(counts, ["g"]).first()
    p = 1 / (1 + np.exp(r.a * s + r.b))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * (s - 100)).sum()) < 1e-6


def test_no_group_in_one_task(spark):
    rows = spark.createDataFrame([("g", 0.5, 1)], "m string, confidence double, correct int")
    plan = judge.calibration(rows, ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_empty(spark):
    rows = spark.createDataFrame([], "m string, confidence double, correct int")
    assert judge.calibration(rows, ["m"]).collect() == []
