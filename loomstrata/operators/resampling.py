"""Bootstrap intervals without a group's rows in one place: multinomial counts from a splittable hash tree.

A group of n rows, in the order of their values, is n places. A resample's n draws go down a binary tree over the places:
a node with d draws gives its left half Binomial(d, its share) of them, and the rest to the right. The left half is the
largest power of two below the node's size, so all but the nodes on the right edge halve evenly, and Binomial(d, 1/2) is the
number of bits in d random ones. Bits come from a hash of (seed, resample, node), so any task can go down to the places that
it holds, and all tasks agree: counts over the group add up to n in every resample, whatever the partitioning. Equal values
are one interval of places, whose draws need no look at the rows within.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written
from .statistics import rho_of_counts, smaller

#: Distinct values (or pairs) that a task holds at once, and resamples that it makes of them.
BLOCK, CHUNK = 4096, 500
#: Nodes with more draws than this take numpy's exact binomial, keyed by the same hash, in place of single bits.
MANY = 1 << 15
#: Fixed values of the hash: an odd stride, and the multipliers and shifts of a 32-bit mixer with low bias.
STRIDE, MIX = 0x9E3779B9, ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers."""
    x = np.asarray(x, np.uint32).copy()
    for shift, times in MIX:
        x ^= x >> np.uint32(shift)
        if times is not None:
            x *= np.uint32(times)
    return x


def node_key(seed: int, resamples: np.ndarray, low: int, size: int) -> np.ndarray:
    """The hash of a node for each resample, from which its random words follow."""
    key = mix((resamples.astype(np.uint64) + np.uint64(seed * STRIDE % (1 << 32))).astype(np.uint32))
    for part in (low % (1 << 32), low >> 32, size % (1 << 32), size >> 32):
        key = mix(key ^ np.uint32(part))
    return key


def word(key: np.ndarray, k: int) -> np.ndarray:
    """The k-th random word of a node."""
    return mix(key + np.uint32(k * STRIDE % (1 << 32)))


def left_draws(seed: int, resamples: np.ndarray, low: int, size: int, left: int, draws: np.ndarray) -> np.ndarray:
    """How many of each resample's draws at a node go to its first `left` places of `size`."""
    key, out, most = node_key(seed, resamples, low, size), np.zeros(len(draws), np.int64), int(draws.max(initial=0))
    many = draws > MANY
    if many.any():
        for i in np.flatnonzero(many):
            stream = np.random.Generator(np.random.Philox(key=int(key[i]) + (int(resamples[i]) << 32)))
            out[i] = stream.binomial(int(draws[i]), left / size)
        most = int(draws[~many].max(initial=0))
    few = np.where(many, 0, draws)
    if 2 * left == size:
        for k in range(-(-most // 32)):
            bits = np.clip(few - 32 * k, 0, 32)
            mask = ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            out += np.bitwise_count(word(key, k) & mask)
    else:
        for k in range(most):
            out += (k < few) & ((word(key, k).astype(np.uint64) * np.uint64(size) >> np.uint64(32)) < left)
    return out


def counts(seed: int, resamples: np.ndarray, n: int, edges: np.ndarray) -> np.ndarray:
    """Draws in each interval [edges[i], edges[i + 1]) of n places: a row a resample, a column an interval."""
    out = np.zeros((len(resamples), max(0, len(edges) - 1)), np.int64)
    waiting = [(0, n, np.full(len(resamples), n, np.int64))]
    while waiting:
        low, size, draws = waiting.pop()
        first, last = np.searchsorted(edges, low, "right"), np.searchsorted(edges, low + size, "left")
        if first == last:  # no edge inside: all of it lies in one interval, or outside all
            if 0 < first < len(edges):
                out[:, first - 1] += draws
            continue
        left = 1 << ((size - 1).bit_length() - 1)
        there = left_draws(seed, resamples, low, size, left, draws)
        waiting += [(low, left, there), (low + left, size - left, draws - there)]
    return out


def _blocks(table: DataFrame, by: list[str], resamples: int) -> DataFrame:
    """table (by, _before, _m and values, a row for each distinct one) with n, _block and _chunk: a row for each chunk of
    resamples. A group of up to BLOCK rows is one block; a larger one is cut by places, so no block has more rows."""
    sizes = table.groupBy(*by).agg(F.sum("_m").alias("n"), F.count("*").alias("_rows"))
    names = {c: f"_of{i}" for i, c in enumerate(by)}
    same = F.lit(True)
    for c, to in names.items():
        same &= F.col(c).eqNullSafe(F.col(to))
    rows = table.join(sizes.withColumnsRenamed(names), same).drop(*names.values())
    block = F.when(F.col("_rows") <= BLOCK, 0).otherwise(F.floor(F.col("_before") / BLOCK)).cast("long")
    chunks = F.sequence(F.lit(0), F.lit(-(-resamples // CHUNK) - 1))
    return rows.withColumn("_block", block).withColumn("_chunk", F.explode(chunks))


def _drawn(rows: pd.DataFrame, resamples: int, seed: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A block's rows in order, the resamples of its chunk and the draws of each row in each of them."""
    rows = rows.sort_values("_before", ignore_index=True)
    begin, size = rows["_before"].to_numpy(np.int64), rows["_m"].to_numpy(np.int64)
    chunk = int(rows["_chunk"].iloc[0])
    b = np.arange(chunk * CHUNK, min(resamples, (chunk + 1) * CHUNK), dtype=np.int64)
    edges = np.append(begin, begin[-1] + size[-1])
    return rows, b, counts(seed, b, int(rows["n"].iloc[0]), edges)


def _keys(rows: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)


def _named(rows: pd.DataFrame, by: list[str], times: int) -> dict:
    return {c: pd.Series([rows[c].iloc[0]] * times, dtype=object) for c in by}


def bootstrap_mean(rows: DataFrame, value: str, by: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, mean, n, ci_low, ci_high): the mean and the 2.5 and 97.5 percentiles of resampled means by group. Null values
    are skipped. Draws depend on (seed, resample, n) and on places in the order of values, so a run repeats."""
    use = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_m"))
    table = written(smaller(use, "_v", by), "places")

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        r, b, c = _drawn(part, resamples, seed)
        return pd.DataFrame(_named(r, by, len(b)) | {"n": int(r["n"].iloc[0]), "_b": b, "_s": c @ r["_v"].to_numpy(np.float64)})

    out = _blocks(table, by, resamples).groupBy(*by, "_block", "_chunk").applyInPandas(sums, f"{_keys(rows, by)}n long, _b long, _s double")
    means = out.groupBy(*by, "n", "_b").agg((F.sum("_s") / F.col("n")).alias("_x"))
    ends = [F.percentile("_x", F.lit(q)).alias(c) for q, c in ((0.025, "ci_low"), (0.975, "ci_high"))]
    whole = table.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_m")) / F.sum("_m")).alias("mean"))
    return _beside(means.groupBy(*by, "n").agg(*ends), whole, by).select(*by, "mean", "n", "ci_low", "ci_high")


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of two tables by group, nulls equal."""
    names = {c: f"_of{i}" for i, c in enumerate(by)}
    same = F.lit(True)
    for c, to in names.items():
        same &= F.col(c).eqNullSafe(F.col(to))
    return left.join(right.withColumnsRenamed(names), same, "left").drop(*names.values())


def _weighted_rho(c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman's rho of each row of weights c over pairs (x, y); NaN where x or y has one value in it."""

    def ranks(v: np.ndarray) -> np.ndarray:
        code = np.unique(v, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        begin = np.flatnonzero(np.diff(code[order], prepend=-1))
        w = np.add.reduceat(c[:, order], begin, axis=1)
        return (np.cumsum(w, axis=1) - w + (w + 1) / 2)[:, code]

    n = c.sum(axis=1)
    rx, ry = ranks(x), ranks(y)
    part = lambda a, b: n * (c * a * b).sum(1) - (c * a).sum(1) * (c * b).sum(1)
    xx, yy = part(rx, rx), part(ry, ry)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((xx > 0) & (yy > 0), part(rx, ry) / (np.sqrt(xx) * np.sqrt(yy)), np.nan)


def _pairs(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, _x, _y, _m, _before): distinct pairs with their number and that of the group's smaller pairs, staged."""
    use = rows.dropna(subset=[x, y]).groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_m"))
    use = written(use, "pairs")
    below = smaller(use.groupBy(*by, "_x").agg(F.sum("_m").alias("_m")), "_x", by, to="_below_x").drop("_m")
    within = smaller(use, "_y", [*by, "_x"], to="_below_y")
    names = {c: f"_of{i}" for i, c in enumerate([*by, "_x"])}
    same = F.lit(True)
    for c, to in names.items():
        same &= F.col(c).eqNullSafe(F.col(to))
    out = within.join(below.withColumnsRenamed(names), same).drop(*names.values())
    return written(out.withColumn("_before", F.col("_below_x") + F.col("_below_y")).drop("_below_x", "_below_y"), "places")


def bootstrap_spearman(rows: DataFrame, x: str, y: str, by: list[str], resamples: int = 4000, seed: int = 7) -> DataFrame:
    """(by, n, rho, ci_low, ci_high, n_resamples): Spearman's rho of the rows with both values and the 2.5 and 97.5
    percentiles of resampled ones, by group. Rows are drawn as pairs; resamples with one value only of either are skipped
    and n_resamples counts the rest; without any the percentiles are null.

    A group of up to BLOCK distinct pairs is ranked where its draws are made. Of a larger one, blocks send the pairs that
    were drawn, and ranks come from counts by value in each (group, resample), as those of the rows themselves do."""
    table = _pairs(rows, x, y, by)
    dealt = _blocks(table, by, resamples)
    keys = _keys(rows, by)

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        r, b, c = _drawn(part, resamples, seed)
        rho = _weighted_rho(c.astype(np.float64), r["_x"].to_numpy(), r["_y"].to_numpy())
        return pd.DataFrame(_named(r, by, len(b)) | {"_r": rho})

    small = dealt.filter(F.col("_rows") <= BLOCK).groupBy(*by, "_chunk").applyInPandas(whole, f"{keys}_r double")
    found = small.withColumn("_r", F.when(~F.isnan("_r"), F.col("_r")))
    large = dealt.filter(F.col("_rows") > BLOCK)
    if not large.isEmpty():

        def drawn(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            r, b, c = _drawn(part, resamples, seed)
            at, of = np.nonzero(c)
            return pd.DataFrame(_named(r, by, len(at)) | {"_b": b[at], "_x": r["_x"].to_numpy()[of], "_y": r["_y"].to_numpy()[of], "_m": c[at, of]})

        sent = large.groupBy(*by, "_block", "_chunk").applyInPandas(drawn, f"{keys}_b long, _x double, _y double, _m long")
        found = found.unionByName(rho_of_counts(written(sent, "drawn"), "_x", "_y", [*by, "_b"]).select(*by, F.col("rho").alias("_r")))
    ends = [F.percentile("_r", F.lit(q)).alias(c) for q, c in ((0.025, "ci_low"), (0.975, "ci_high"))]
    out = found.groupBy(*by).agg(*ends, F.count("_r").alias("n_resamples"))
    return _beside(out, rho_of_counts(table.drop("_before"), "_x", "_y", by), by).select(*by, "n", "rho", "ci_low", "ci_high", "n_resamples")
