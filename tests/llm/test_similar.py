"""Jaccard join and decontamination against brute force."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomstrata.llm import components, decontaminate, jaccard_join, shingles

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows: list[tuple[int, str | None]], t: Fraction) -> dict[int, int]:
    sets = {i: shingle_set(x) for i, x in rows}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_shingles_match_words():
    texts = ["", " ", "a", "a b c d", "A b C d e", "a b c d e f", "x\x0by\x0cz\r\nq\tw e", "É é   a b c", "a " * 30]
    values, at = shingles.shingle_sets(texts)
    seen: dict = {}
    for t, a, b in zip(texts, at[:-1], at[1:]):
        got, want = values[a:b].tolist(), shingle_set(t)
        assert len(got) == len(want) and got == sorted(got)
        for s in want:
            seen.setdefault(s, set(got)).intersection_update(got)
    assert all(seen.values())
    keys = shingles.set_keys(*shingles.shingle_sets(["a b c d e", "A  B c\nd e", "a b c d f", ""]))
    assert (keys[0] == keys[1]).all() and (keys[0] != keys[2]).any() and not keys[3].any()


@pytest.mark.parametrize("t", [Fraction(3, 4), Fraction(1, 2), Fraction(9, 10)])
def test_components_like_brute_force(spark, t):
    rng = random.Random(11)
    rows: list[tuple[int, str]] = []
    line = prose(rng, 12)
    for g in range(14):  # groups of edited copies, some sharing a frequent line
        words = (line + " " + prose(rng, rng.choice([6, 20, 60, 150]))).split() if g % 2 else prose(rng, rng.choice([8, 40, 90])).split()
        for _ in range(rng.choice([1, 2, 9, 25])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1, 2])] = [prose(rng, 1)]
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, x) for i, x in enumerate(["p q", "P  q", "p q r", "", "z " * 50, "z " * 40])]
    rng.shuffle(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), t=t).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, t)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(x)) for i, x in rows}


def test_odd_rows(odd, empty):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == odd.count() and jaccard_join.jaccard_components(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[31].component_id == 0 and by[40].component_id == 1 and by[43].component_id == 1
    assert (by[50].n_shingles, by[50].component_id, by[52].n_shingles) == (0, 50, 0) and by[54].component_id == 53
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles > 1} == {2} and by[60].component_id == 3


def test_component_rounds(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1400))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_passages_like_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate([15, 16, 22, 23, 30, 37, 45, 59, 90, 7, 4, 3])] + [(90, ""), (91, None), (None, prose(rng, 30))]
    docs = []
    for i in range(60):
        words = prose(rng, rng.choice([0, 3, 50, 300])).split()
        item = rng.choice(items)[1] or ""
        w = item.split()
        if i % 3 == 1 and len(w) > 6:
            w[rng.choice([0, 1, -1, -2])] = "edited"
        if i % 4:
            at = rng.randint(0, len(words))
            words[at:at] = [x.upper() if i % 5 == 0 else x for x in w]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[5][1])]
    sets = {k: shingle_set(t, 5) for k, t in enumerate(t for _, t in items)}
    df = Counter(s for x in sets.values() for s in x)
    weigh = lambda xs: sum(math.log1p(len(items) / df[s]) if s in df else math.log1p(len(items)) for s in xs)
    want = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        for k, (i, x) in enumerate(items):
            n = len(WORD.findall(x or ""))
            for a in range(len(w)) if n else ():
                have = shingle_set(" ".join(w[a : a + n]))
                if have & sets[k] and weigh(have & sets[k]) >= 0.75 * weigh(have | sets[k]):
                    want[d, i] = max(want.get((d, i), 0), weigh(have & sets[k]) / weigh(have | sets[k]))
    got = decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert found.keys() <= want.keys() and all(found[k] == pytest.approx(want[k]) for k in found)
    whole = {k for k, v in want.items() if v > 0.999}
    assert whole <= found.keys() and len(found) >= 0.95 * len(want)


def test_no_items(odd, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(odd, none).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.find_passages(empty, items).count() == 0 and decontaminate.find_passages(odd, items).count() == 0


def test_passes_share_weights(spark, monkeypatch):
    rng = random.Random(9)
    common = [prose(rng, 20) for _ in range(3)]
    items = [(i, f"{prose(rng, 12)} {common[i % 3]} {prose(rng, 12)}") for i in range(30)]
    docs = [(i, f"{prose(rng, 30)} {t[: -8 - i % 5]} {prose(rng, 30)}") for i, t in items]
    make = lambda rows, names: spark.createDataFrame(rows, f"{names} long, text string")
    find = lambda: sorted(tuple(r) for r in decontaminate.find_passages(make(docs, "doc_id"), make(items, "item_id")).collect())
    want = find()
    assert len(want) > 10 and any(r[4] < 1 for r in want)
    monkeypatch.setattr(decontaminate, "ITEMS", 8)
    assert find() == [(*r[:4], pytest.approx(r[4], abs=1e-12), r[5]) for r in want]


def test_edits_in_the_middle_are_found(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 37, 45, 52, 60, 75, 90, 120] * 5)]
    sets = [shingle_set(t) for _, t in items]
    df = Counter(s for x in sets for s in x)
    weigh = lambda xs: sum(math.log1p(len(items) / df.get(s, 1)) for s in xs)
    docs, want = [], set()
    for k in range(400):
        i, text = items[k % len(items)]
        w = text.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w) // 4, 3 * len(w) // 4)] = prose(rng, 1)
        have = shingle_set(" ".join(w))
        docs.append((k, f"{prose(rng, rng.randint(20, 90))} {' '.join(w)} {prose(rng, 60)}"))
        if weigh(have & sets[i]) >= 0.75 * weigh(have | sets[i]):
            want.add((k, i))
    got = decontaminate.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(want) > 150 and len(found & want) >= 0.9 * len(want) and found <= {(k, items[k % len(items)][0]) for k in range(400)}


def test_long_lists_are_split(spark, monkeypatch):
    """Posting lists dealt to many tasks, with groups that one line joins in a list."""
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 3)
    rng = random.Random(13)
    line = prose(rng, 14)
    rows: list[tuple[int, str]] = []
    for _ in range(9):
        words = (line + " " + prose(rng, 30)).split()
        for _ in range(6):
            w = list(words)
            w[rng.randrange(14, len(w))] = prose(rng, 1)
            rows.append((len(rows), " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), t=Fraction(1, 2)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, Fraction(1, 2))


def test_third_order_bits():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        b = np.unique(np.concatenate([a[:36], rng.integers(0, 1 << 62, 3).astype(np.uint64)]))
        x, y = (jaccard_join._third(np.unique(z), Fraction(3, 4)) for z in (a, b))
        assert len(np.intersect1d(x, y)) and any(p & q for p, q in zip(jaccard_join._bits(x), jaccard_join._bits(y)))


def test_many_rows_of_one_id_and_text(spark, monkeypatch):
    """Two near copies of 10,000 rows each are compared once; each row gets the component."""
    rng = random.Random(6)
    base = prose(rng, 60)
    rows = spark.createDataFrame([(1, base), (2, base + " end"), (3, prose(rng, 60))], "doc_id long, text string")
    rows = rows.crossJoin(spark.range(10_000).select(F.col("id").alias("k"))).filter("doc_id < 3 or k < 2").drop("k").repartition(6)
    seen = []
    links = jaccard_join.links

    def watched(prefixes, sets, t):
        seen.append((sets.count(), sets.select("id").distinct().count()))
        return links(prefixes, sets, t)

    monkeypatch.setattr(jaccard_join, "links", watched)
    got = jaccard_join.jaccard_components(rows).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, 10_000), (2, 1, 10_000), (3, 3, 2)}
    assert seen == [(2, 2)]


def test_sample_of_an_id_with_many_rows(spark):
    """A labelled id in 10,000 rows, of one text and of several: one text of it in the sample, within the byte limit."""
    from loomstrata.llm import samples

    rows = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd number").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(8, "eight"), (9, ""), (9, None), (10, "ten")], "doc_id long, text string"))
    chosen = spark.createDataFrame([(7, 1), (8, 0), (9, 1), (10, 0)], "id long, label int")
    got = samples.texts_of(rows.repartition(5), chosen)
    assert len(got) == 3 and got[0][0] in ("even", "odd number") and got[1:] == [("eight", 0), ("ten", 0)]
    assert samples.texts_of(rows, chosen, most_bytes=3) == [("ten", 0)] or len(samples.texts_of(rows, chosen, most_bytes=3)) <= 1
