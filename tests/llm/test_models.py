"""Learned operators: parts against brute force, results by held-out accuracy, odd input."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstrata.llm import langid, quality, queries, toxicity


@pytest.fixture(scope="module")
def sf(data):
    return data.replace("sf0.001", "sf0.01")


def test_presence_is_the_blended_kernel():
    texts = ["the cat sat", "The cat; SAT!", "le chat", "12 .. !", ""]
    x = langid.presence(texts)
    assert np.allclose(x[0], x[1]) and not x[3].any() and not x[4].any()
    assert np.isclose(x[0] @ x[0], len(langid.SPECTRUM)) and 0 < x[0] @ x[2] < 2
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    pad = lambda t: f" {t} "
    want = sum(len(grams(pad("the cat sat"), n) & grams(pad("le chat"), n)) / np.sqrt(len(grams(pad("the cat sat"), n)) * len(grams(pad("le chat"), n))) for n in (2, 3))
    want += len(set("thecatsat") & set("lechat")) / np.sqrt(len(set("thecatsat")) * len(set("lechat")))
    assert np.isclose(x[0] @ x[2], want, atol=0.05)  # but for hash collisions


def test_language_accuracy(spark, sf):
    got = queries.op2_string_kernels(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1


def test_language_odd_rows(odd, empty):
    model = langid.train(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[50].lang_pred == by[51].lang_pred == by[52].lang_pred == "und" and by[50].score == 0.0 and by[53].lang_pred in model.names
    assert langid.predict(empty, model).count() == 0
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, at, y = rng.normal(size=(9, quality.FEATURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    h, a = quality.HIDDEN, quality.ATTENTION
    p = {"w": rng.normal(size=(quality.FEATURES, h)), "b": rng.normal(size=h), "v": rng.normal(size=(h, a)), "u": rng.normal(size=(h, a)), "a": rng.normal(size=a), "c": rng.normal(size=h), "d": np.array(0.3)}
    weight = np.array([0.5, 1.0, 2.0])

    def loss(q: dict) -> float:
        s = quality._forward(q, x, at)["y"]
        return float(-(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum())

    g = quality._gradients(p, x, at, y, weight)
    for k, v in p.items():
        for i in itertools.islice(np.ndindex(v.shape), 6):
            d = np.zeros_like(v)
            d[i] = 1e-6
            assert abs((loss(p | {k: v + d}) - loss(p | {k: v - d})) / 2e-6 - g[k][i]) < 1e-6
    share = quality._forward(p, x, at)["share"]
    assert np.allclose(np.add.reduceat(share, at[:-1]), 1)


def test_passages():
    texts = ["", "AB!! cd | x", "a" * 1300, "é" * 300, "to to to be"]
    x, at = quality.passages(texts)
    assert np.diff(at).tolist() == [1, 1, 3, 2, 1] and not x[0].any()
    assert x[1, 0] == 2 / 11 and x[1, 7] == 2 / 11 and x[1, 8] == 1 / 11 and x[-1, -6] == 0.5
    for t, a, b in zip(texts, at[:-1], at[1:]):
        alone, _ = quality.passages([t])
        assert np.allclose(alone[:, :-4], x[a:b, :-4]) and np.allclose(alone[:, -2:], x[a:b, -2:])


def _split(spark, sf, name, label, other):
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("doc_id", "score", "predicted", label).collect()
    return got, np.array([r[label] for r in got]), np.array([r.predicted for r in got])


def test_quality_accuracy(spark, sf):
    got, y, p = _split(spark, sf, "op5_attention_quality", "quality", 5)
    assert (y == p).mean() > 0.93 and all(0 <= r.score <= 1 for r in got)


def test_quality_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 1), (50, None, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    assert quality.score(odd, model).count() == odd.count() and quality.score(empty, model).count() == 0
    assert quality.train(odd, labels.limit(0)) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}
    one = quality.train(odd, labels.filter("quality = 1"))
    assert min(r.score for r in quality.score(odd, one).collect()) > 0.9


def test_composition():
    """The composed machine against its parts, run one behind the other."""
    parts = [toxicity._marker("N", 3, "n"), toxicity._marker("R", 12, "r"), toxicity._targets(), toxicity._threats(), toxicity._insults()]
    composed, rng = toxicity.machine(), random.Random(0)
    for _ in range(300):
        states, at = [m.start for m in parts], composed.start
        for symbol in rng.choices("TUVOBSPNRI-", k=30):
            out, points = symbol, [0.0, 0.0, 0.0]
            for i, m in enumerate(parts):
                out, p, states[i] = m.step(states[i], out)
                points = [x + y for x, y in zip(points, p)]
            got = composed.step(at, symbol)
            at = got[2]
            assert got[0] == out and got[1] == pytest.approx(points)


def plain_clause(words: list[str], lexicon: toxicity.Lexicon) -> float:
    """A clause's weight by looking around each word, without machines."""
    kinds = ["I" if lexicon.weight(w) else toxicity.CLASSES.get(w, "-") for w in words]
    total = 0.0
    for i, kind in enumerate(kinds):
        if kind not in "TUVI":
            continue
        negated, reported = "N" in kinds[max(0, i - 3) : i], "R" in kinds[max(0, i - 12) : i]
        weak = (0.6 if kind == "I" else 0.4) ** negated * (0.8 if kind == "I" else 0.6) ** reported
        before = next(((k, i - j) for j, k in reversed([*enumerate(kinds[:i])]) if k in "OBSP"), ("", 99))
        near = before[0] if before[1] <= (3 if before[0] == "P" else 5) else ""
        if kind == "I":
            value = lexicon.weight(words[i])
            if near:
                total += 1.25 * weak * value
                continue
            total += 0.5 * weak * value
            for j in range(i + 1, min(i + 4, len(kinds))):
                if kinds[j] == "I":
                    break
                if kinds[j] in "OBS":
                    total += 0.75 * weak * value
                    break
            continue
        if kind == "V" or near == "O":
            total += 1.5 * weak
            continue
        some = 0.75 * weak if kind == "T" and near in ("B", "S") else 0.0
        total += some
        for j in range(i + 1, min(i + 5, len(kinds))):
            if kinds[j] in "TUV":
                break
            if kinds[j] in "OB":
                total += 1.5 * weak - some
                break
    return total


LEXICON = toxicity.Lexicon({"scum": 5.0}, {"lowei": 4.0})


def test_clauses_against_looking_around():
    rng = random.Random(1)
    s = toxicity.Scorer(LEXICON, [0] * 5)
    words = ["kill", "matarte", "beat", "him", "te", "you", "vous", "she", "tu", "what", "never", "said", "scum", "loweix", "tree", "and", "the", "of"]
    for _ in range(5000):
        clause = rng.choices(words, k=rng.randint(0, 16))
        assert s.clause(clause) == pytest.approx(plain_clause(clause, LEXICON)), clause


def test_threats_in_four_languages():
    w = lambda text: toxicity.Scorer(LEXICON, [0] * 5).clause(text.lower().split())
    plain = ["te voy a matar", "ich werde dich schlagen", "je vais te tuer", "I am killing you", "kills you", "she kills him", "kill you", "quiero matarte", "wir töten euch", "ils vont te frapper"]
    assert {t: w(t) for t in plain} == dict.fromkeys(plain, 1.5)
    assert w("I will kill you") > w("he said he will kill you") > w("he said he will not kill you") > 0
    assert w("I will kill you") > w("you will kill") > w("he said you will kill") > 0
    for t in ("this beat is great", "those beat sticks", "you can burn calories this week", "kill", "kill time", "le prix du pain tue", "beat the drum", "never kill"):
        assert w(t) == 0, t


def test_insults_alone_count_less():
    s = toxicity.Scorer(LEXICON, [0] * 5)
    w = lambda text: s.clause(text.split())
    assert w("you scum") == w("scum like you") == w("what a scum") == 6.25 > w("scum") == w("isolated scum word") == 2.5
    assert w("scum") > w("the paper wrote scum") > w("the paper never wrote scum") > 0 and w("the loweischaft") == 2.0


def test_clause_borders():
    """Both ends of a clause are cut alike: marks within times, numbers and host names end nothing."""
    s = toxicity.Scorer(LEXICON, [0] * 5)
    for text in ("never at 10:30 scum", "never x.y scum", "never 2.5 scum", "you www.a.b scum"):
        ((_, _, weight),) = s.clauses(text)
        assert weight == plain_clause(toxicity.WORD.findall(text), LEXICON) != 2.5
    assert [w for _, _, w in s.clauses("never. scum")] == [2.5] and [w for _, _, w in s.clauses("you:\nscum; scum")] == [2.5, 2.5]
    found = s.clauses("Fine here. But YOU, scum; end\nlast loweix!")
    assert [(a, b) for a, b, _ in found] == [(10, 24), (30, 41)]
    assert s.clauses("") == [] and s.clauses("scummy") == []


def test_lexicon_learns_stems_and_skips_copies():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    copied = " ".join(word() for _ in range(20)) + " copiedword " + word()
    yes = [" ".join([word() for _ in range(20)] + [f"grumf{word()}", "blarg"] + [word() for _ in range(5)]) for _ in range(80)] + [copied] * 30
    no = [" ".join(word() for _ in range(25)) for _ in range(200)]
    lexicon = toxicity.learn(yes, [1] * len(yes))
    assert not lexicon.words
    lexicon = toxicity.learn(yes + no, [1] * len(yes) + [0] * len(no))
    assert "blarg" in lexicon.words and "grumf" in lexicon.stems and "copiedword" not in lexicon.words


def test_toxicity_accuracy(spark, data):
    """On held-out rows, and of each language by itself: a rate over all would hide a language that is missed."""
    sf = data.replace("sf0.001", "sf0.1")
    got, y, p = _split(spark, sf, "op10_toxicity_grammar", "toxic", 4)
    assert (y == p).mean() > 0.97 and p[y == 0].mean() < 0.01 and p[y == 1].mean() > 0.75
    assert all(0 <= r.score <= 1 for r in got)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    of = np.array([lang[r.doc_id] for r in got])
    for name in ("en", "fr", "de", "es"):
        assert p[(y == 1) & (of == name)].mean() > 0.75 and p[(y == 0) & (of == name)].mean() < 0.03, name


def test_toxicity_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(8)] + [(None, 1, 1), (50, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).filter("score > 0.3").count() == 0
    same = odd.filter("doc_id is not null and doc_id < 10").select("doc_id", toxicity.scores(model, F.col("text"), spark).alias("s")).join(toxicity.score(odd, model), "doc_id")
    assert all(r.s == pytest.approx(r.score) for r in same.collect())


def test_letters_of_all_planes(spark):
    adlam, han = "\U0001e900\U0001e901 \U0001e902", "\U00020000\U00020001"
    x = langid.presence([adlam, adlam.lower(), han, "\U0001f600 \U0010ffff"])
    assert x[0].any() and np.allclose(x[0], x[1]) and x[2].any() and not x[3].any()
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([(adlam, "ff"), (han, "zh"), ("plain words", "en")] * 6)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == n for r, n in zip(langid.predict(rows, langid.train(rows)).orderBy("doc_id").collect(), ["ff", "zh", "en"] * 6))


def test_quality_scores_are_probabilities(spark, sf):
    got, y, _ = _split(spark, sf, "op5_attention_quality", "quality", 5)
    assert abs(np.mean([r.score for r in got]) - y.mean()) < 0.03
    x, at, y = np.random.default_rng(1).normal(size=(40, quality.FEATURES)), np.arange(41), np.repeat([1.0, 0.0], [30, 10])
    d = [float(quality.fit(x, at, y, steps=5, prior=p).p["d"]) for p in (0.5, 0.9, None)]
    assert d[1] - d[0] == pytest.approx(np.log(9)) and d[2] - d[0] == pytest.approx(np.log(3))
