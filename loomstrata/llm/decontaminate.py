"""Benchmark decontamination: SimHash fingerprints of item-sized windows, searched by multi-index Hamming blocks, then
verified by weighted-shingle similarity."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored, shielded, staged, tidy
from .shingles import chunks, combine, mix, word_hashes

#: Fingerprints within this distance are all found: four blocks of 16 bits, each searched within distance 1, so one block
#: of any fingerprint within 4 * 2 - 1 bits matches.
RADIUS, BLOCKS = 7, 4
#: Items, and bytes of their texts, whose tables are sent to the tasks at once, about; more take more passes.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
_ONE_OFF = np.array([0, *(1 << b for b in range(16))], np.uint16)


def window_of(words: int) -> int:
    """Window length for an item: from a grid of steps of an eighth, at most nine tenths of the item (so that windows at a
    stride meet it in full), the whole item if it is short."""
    if words < 10:
        return words
    w = 8
    while (step := w + max(1, w // 8)) <= 0.9 * words:
        w = step
    return w


def running(words: np.ndarray, block: int = 16) -> np.ndarray:
    """Running sums of the words' hash bits as +1 and -1, wrapping in 16 bits; row i is before word i. Sums are taken
    within blocks of rows, for all blocks at once, and then over the blocks."""
    n = len(words)
    sums = np.zeros((-(-(n + 1) // block) * block, 64), np.int16)
    bits = sums[1 : n + 1]
    bits[:] = np.unpackbits(mix(words).view(np.uint8).reshape(-1, 8), axis=1)
    bits *= 2
    bits -= 1
    by_block = sums.reshape(-1, block, 64)
    for i in range(1, block):
        by_block[:, i] += by_block[:, i - 1]
    by_block[1:] += np.cumsum(by_block[:-1, -1], axis=0, dtype=np.int16)[:, None]
    return sums[: n + 1]


def fingerprints(sums: np.ndarray, w: int, stride: int) -> np.ndarray:
    """SimHash of every window of w words at a stride."""
    d = sums[w::stride] - sums[: len(sums) - w : stride]
    return np.packbits(d > 0, axis=1).view(np.uint64).ravel()


class Bench:
    """Items' fingerprints by window length, their block tables, and the weighted shingles that verify."""

    def __init__(self, items: list[tuple[int, str]], weights: dict[int, float], rare: float, k: int = 5) -> None:
        self.k, self.rare, self.weights = k, rare, weights
        words, at = word_hashes([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:])]
        self.sets = [self.shingles(w) for w in self.words]
        groups: dict[int, list[int]] = {}
        for j, w in enumerate(self.words):
            if len(w):
                groups.setdefault(window_of(len(w)), []).append(j)
        self.groups = []
        for w, mine in sorted(groups.items()):
            prints = [fingerprints(running(self.words[j]), w, 1) for j in mine]
            of = np.repeat(mine, [len(p) for p in prints])
            shift = np.concatenate([np.arange(len(p)) for p in prints])
            prints = np.concatenate(prints)
            stride = min(len(self.words[j]) for j in mine) - w + 1
            tables = []
            for b in range(BLOCKS):
                near = (prints.view(np.uint16).reshape(-1, BLOCKS)[:, b][:, None] ^ _ONE_OFF).ravel()
                order = np.argsort(near, kind="stable")
                begin = np.searchsorted(near[order], np.arange((1 << 16) + 1)).astype(np.int32)
                tables.append((begin[1:] > begin[:-1], begin, np.repeat(np.arange(len(prints), dtype=np.int32), 17)[order]))
            self.groups.append((w, stride, prints, of, shift, tables))

    def shingles(self, words: np.ndarray) -> dict[int, float]:
        if not len(words):
            return {}
        return {x: self.weights.get(x, self.rare) for x in combine(words, min(self.k, len(words))).tolist()}

    def near(self, sums: np.ndarray) -> set[tuple[int, int]]:
        """(item, word where it would begin) of all windows with a fingerprint within RADIUS of one of the item's."""
        found: set[tuple[int, int]] = set()
        for w, stride, prints, of, shift, tables in self.groups:
            if len(sums) <= w:
                continue
            mine = fingerprints(sums, w, stride)
            blocks = mine.view(np.uint16).reshape(-1, BLOCKS)
            for b, (some, begin, entries) in enumerate(tables):
                hit = np.flatnonzero(some[blocks[:, b]])
                if not len(hit):
                    continue
                block = blocks[hit, b].astype(np.int64)
                lo, n = begin[block], begin[block + 1] - begin[block]
                at = np.repeat(hit, n)
                entry = entries[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                close = np.flatnonzero(np.bitwise_count(mine[at] ^ prints[entry]) <= RADIUS)
                found.update(zip(of[entry[close]].tolist(), (at[close] * stride - shift[entry[close]]).tolist()))
        return found

    def best(self, words: np.ndarray, item: int, begin: int) -> tuple[float, int]:
        """The highest similarity of the item with windows of its length that begin within four words of begin."""
        size, want = len(self.words[item]), self.sets[item]
        whole, top = sum(want.values()), (0.0, begin)
        for a in sorted(range(max(0, begin - 4), min(len(words) - 1, begin + 4) + 1), key=lambda a: abs(a - begin)):
            have = self.shingles(words[a : a + size])
            common = sum(x for s, x in want.items() if s in have)
            top = max(top, (common / (whole + sum(have.values()) - common), a), key=lambda x: x[0])
            if top[0] == 1.0:
                break
        return top


def find_passages(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.75, k: int = 5) -> DataFrame:
    """A row for each document and benchmark item with a passage of it: id_col, item_col, start_word, n_words, similarity,
    n_passages; the passage is the most similar one. Similarity is of weighted k-word shingles: common weight over the
    weight of either, a shingle's weight being log(1 + items / items with it); least or more counts.

    Null and empty texts have no passages, and items without words match nothing. Items of fewer than k words are one
    shingle of all their words. Repeated rows and items get a row each; null ids stay null. Other columns are not read.
    Items are read in blocks by a hash of their id and text, each block a pass, of about ITEMS items or ITEM_BYTES.
    """
    spark = df.sparkSession
    rows = shielded(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("length(text) > 0"))
    bench = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, math.ceil(n / ITEMS), math.ceil(size / ITEM_BYTES))
    schema = "id long, no_id boolean, item long, start_word long, n_words long, similarity double, n_passages long"
    shared = _shared_shingles(bench, k) if passes > 1 else None
    out = None
    for p in range(passes):
        block = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p)
        # of the counts over all items a pass gets those of its own items' shingles
        mine = None if shared is None else {r["s"] % 2**64: r["n"] for r in shared.join(_shingles_of(block, k).distinct(), "s").collect()}
        texts = [(r["item"], r["text"]) for r in block.orderBy("item", "text").collect()]
        got = rows.mapInPandas(tidy(_search(spark, texts, least, k, n if passes > 1 else None, mine)), schema)
        out = got if out is None else out.unionByName(got)
    return restored(out, id_col).withColumnRenamed("item", item_col)


def _item_shingles(text: str, k: int) -> set[int]:
    w, _ = word_hashes([text])
    return set(combine(w, min(k, len(w))).tolist()) if len(w) else set()


def _shingles_of(bench: DataFrame, k: int) -> DataFrame:
    """(s): the distinct shingles of each item."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [s for t in b["text"] for s in _item_shingles(t, k)]
            yield pd.DataFrame({"s": np.array(found, np.uint64).view(np.int64)})

    return bench.select("text").mapInPandas(tidy(each), "s long")


def _shared_shingles(bench: DataFrame, k: int) -> DataFrame:
    """(s, n), staged: shingles that two items or more have, and how many. One that a single item has weighs as much as one
    of no item."""
    return staged(_shingles_of(bench, k).groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"), "shared_shingles")


def _search(spark, items: list[tuple[int, str]], least: float, k: int, total: int | None = None, counts: dict[int, int] | None = None):
    """total and counts are of all items, where items is one block of them; counts has the block's shingles."""
    if counts is None:
        seen: Counter[int] = Counter()
        for _, t in items:
            seen.update(_item_shingles(t, k))
        total, counts = len(items), seen
    weights = {s: math.log1p(total / n) for s, n in counts.items()}
    sent = spark.sparkContext.broadcast((items, weights, math.log1p(total or 1)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bench = Bench(*sent.value, k)
        for b in batches:
            texts, ids, out = b["text"].tolist(), list(zip(b["id"].tolist(), b["no_id"].tolist())), []
            for i, j in chunks(texts):
                words, at = word_hashes(texts[i:j])
                # windows over the whole chunk; those that cross documents fail when verified within their document
                top: dict[tuple[int, int], tuple] = {}
                tried: set[tuple[int, int, int]] = set()
                for item, begin in sorted(bench.near(running(words))) if len(bench.ids) else ():
                    size = len(bench.words[item])
                    for d in range(max(0, int(np.searchsorted(at, begin, "right")) - 1), min(len(at) - 1, int(np.searchsorted(at, begin + size, "left")) + 1)):
                        if d >= len(at) - 1 or at[d] >= begin + size or at[d + 1] <= begin:
                            continue
                        value, a = bench.best(words[at[d] : at[d + 1]], item, min(max(0, begin - int(at[d])), int(at[d + 1] - at[d])))
                        if value >= least and (d, item, a) not in tried:
                            tried.add((d, item, a))
                            old = top.get((d, item), (0.0, 0, 0))
                            apart = not old[2] or all(abs(a - x) >= size for x in old[3])
                            places = [*(old[3] if old[2] else ()), *([a] if apart else ())]
                            top[d, item] = (*max((value, a), old[:2], key=lambda x: x[0]), len(places), places)
                out += [(*ids[i + d], bench.ids[item], a, len(bench.words[item]), float(v), m) for (d, item), (v, a, m, _) in top.items()]
            yield pd.DataFrame(out, columns=["id", "no_id", "item", "start_word", "n_words", "similarity", "n_passages"]).assign(item=pd.array([x[2] for x in out], dtype="Int64"))

    return search
