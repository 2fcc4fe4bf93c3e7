"""Bootstraps: the hash tree's counts, their distribution, agreement of tasks, and intervals against plain resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from loomstrata.functions import special
from loomstrata.operators import resampling


def plain_counts(seed: int, b: int, n: int) -> list[int]:
    """The tree by recursion over single places, in Python integers."""

    def mixed(x: int) -> int:
        x ^= x >> 16
        x = x * 0x7FEB352D % 2**32
        x ^= x >> 15
        x = x * 0x846CA68B % 2**32
        return x ^ (x >> 16)

    def down(low: int, size: int, draws: int) -> list[int]:
        if size == 1:
            return [draws]
        key = mixed((b + seed * 0x9E3779B9) % 2**32)
        for part in (low, 0, size, 0):
            key = mixed(key ^ part)
        words = [mixed((key + k * 0x9E3779B9) % 2**32) for k in range(draws + 1)]
        left = 2 ** ((size - 1).bit_length() - 1)
        if 2 * left == size:
            gone = sum((words[k // 32] >> (k % 32)) & 1 for k in range(draws))
        else:
            gone = sum((words[k] * size) >> 32 < left for k in range(draws))
        return down(low, left, gone) + down(low + left, size - left, draws - gone)

    return down(0, n, n)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 333])
def test_counts_against_recursion(n):
    b = np.arange(20)
    got = resampling.counts(5, b, n, np.arange(n + 1))
    assert got.tolist() == [plain_counts(5, int(k), n) for k in b]
    assert (got.sum(axis=1) == n).all()


def test_tasks_agree():
    """Intervals of any kind have the sums of their places, whoever asks, and wherever the group's end is."""
    n, b = 100_000, np.arange(30)
    edges = np.unique(np.random.default_rng(1).integers(0, n + 1, 200))
    whole = resampling.counts(9, b, n, np.append(np.append(0, edges), n)[np.diff(np.append(np.append(0, edges), n), prepend=-1) > 0])
    assert (whole.sum(axis=1) == n).all()
    parts = np.concatenate([resampling.counts(9, b, n, edges[i : i + 11]) for i in range(0, len(edges) - 1, 10)], axis=1)
    assert (parts == resampling.counts(9, b, n, edges)).all()
    assert (resampling.counts(9, b[10:20], n, edges) == resampling.counts(9, b, n, edges)[10:20]).all()


@pytest.mark.parametrize("n,interval", [(50, (3, 11)), (3000, (1000, 2900)), (2_000_000, (0, 1_100_000)), (3 * 10**9, (10**9, 2 * 10**9))])
def test_counts_are_binomial(n, interval):
    got = resampling.counts(1, np.arange(2000), n, np.array(interval))[:, 0]
    p = (interval[1] - interval[0]) / n
    mean, sd = n * p, (n * p * (1 - p)) ** 0.5
    assert abs(got.mean() - mean) < 5 * sd / 2000**0.5 and 0.92 < got.std() / sd < 1.08


def test_mean(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 300 + ["b"] * 40, "v": [*rng.exponential(size=300).round(2), *rng.normal(size=40)]})
    rows = spark.createDataFrame([*map(tuple, pdf.itertuples(index=False)), (None, 1.0), (None, 2.0), ("a", None)], "g string, v double")
    runs = [{r.g: r for r in resampling.bootstrap_mean(f, "v", ["g"], 4000).collect()} for f in (rows, rows.repartition(7))]
    for g in ("a", "b", None):
        assert runs[0][g].n == runs[1][g].n and [runs[0][g][c] for c in ("mean", "ci_low", "ci_high")] == pytest.approx([runs[1][g][c] for c in ("mean", "ci_low", "ci_high")])
    for g, part in pdf.groupby("g"):
        v = part.v.to_numpy()
        means = v[rng.integers(0, len(v), (20_000, len(v)))].mean(axis=1)
        r = runs[0][g]
        assert r.mean == pytest.approx(v.mean()) and r.n == len(v)
        assert abs(r.ci_low - np.percentile(means, 2.5)) < 0.15 * means.std() and abs(r.ci_high - np.percentile(means, 97.5)) < 0.15 * means.std()
    assert (runs[0][None].ci_low, runs[0][None].ci_high, runs[0][None].n) == (1.0, 2.0, 2)
    assert resampling.bootstrap_mean(rows.limit(0), "v", ["g"]).collect() == []


def test_mean_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([("a", float(i * i % 50)) for i in range(400)] + [("a", 7.0)] * 5000, "g string, v double")
    one = resampling.bootstrap_mean(rows, "v", ["g"], 600).first()
    monkeypatch.setattr(resampling, "BLOCK", 8)
    many = resampling.bootstrap_mean(rows, "v", ["g"], 600).first()
    assert (many.mean, many.ci_low, many.ci_high, many.n) == pytest.approx((one.mean, one.ci_low, one.ci_high, one.n))


def test_spearman(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60).round(1)
    a = list(zip(["a"] * 60, x.tolist(), (x + rng.normal(size=60)).round(1).tolist()))
    rows = spark.createDataFrame([*a, *[("flat", float(i), 5.0) for i in range(4)], ("a", None, 1.0), ("two", 0.0, 1.0), ("two", 1.0, 2.0)], "g string, x double, y double")
    got = {r.g: r for r in resampling.bootstrap_spearman(rows, "x", "y", ["g"], 1000).collect()}
    xs, ys = np.array([r[1] for r in a]), np.array([r[2] for r in a])
    rho = lambda i: np.corrcoef(special.average_ranks(xs[i]), special.average_ranks(ys[i]))[0, 1]
    draws = [rho(rng.integers(0, 60, 60)) for _ in range(4000)]
    r = got["a"]
    assert r.rho == pytest.approx(rho(np.arange(60))) and (r.n, r.n_resamples) == (60, 1000)
    assert abs(r.ci_low - np.percentile(draws, 2.5)) < 0.3 * np.std(draws) and abs(r.ci_high - np.percentile(draws, 97.5)) < 0.3 * np.std(draws)
    assert (got["flat"].n_resamples, got["flat"].rho, got["flat"].ci_low) == (0, None, None)
    assert 400 < got["two"].n_resamples < 600 and got["two"].ci_low == pytest.approx(1)
    monkeypatch.setattr(resampling, "BLOCK", 8)
    again = {r.g: r for r in resampling.bootstrap_spearman(rows, "x", "y", ["g"], 1000).collect()}
    for g, r in got.items():
        assert again[g].n_resamples == r.n_resamples
        assert [again[g][c] for c in ("rho", "ci_low", "ci_high")] == pytest.approx([r[c] for c in ("rho", "ci_low", "ci_high")])


def test_no_group_is_collected(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0)], "g string, x double, y double")
    for out in (resampling.bootstrap_mean(rows, "x", ["g"], 10), resampling.bootstrap_spearman(rows, "x", "y", ["g"], 10)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "collect_set" not in plan
