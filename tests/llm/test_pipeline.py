"""The pipeline, stage by stage, against brute force over its own input."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomstrata.llm import tokens, toxicity
from loomstrata.llm.common import read

from .test_similar import shingle_set


def test_stages(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs = read(spark, data, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "packing"]

    one = stages["toxicity"](spark, docs, data).cache()
    model = toxicity.train(docs, read(spark, data, "labels"))
    s = toxicity.Scorer(model.lexicon, model.coefficients)
    clean = {i for i, t in before.items() if s.score(np.array([s.features(t or "")]))[0] < 0.3}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == clean and len(clean) < len(before)

    two = stages["exact_dedup"](spark, one, data).cache()
    first: dict[str, int] = {}
    for i in sorted(clean):
        first.setdefault(before[i] or "", i)
    assert {r.doc_id for r in two.collect()} == set(first.values())

    three = stages["jaccard_join"](spark, two, data).cache()
    ids, sets = sorted(first.values()), {}
    root = {i: i for i in ids}
    index: dict = {}
    for i in ids:
        sets[i] = shingle_set(before[i])
        for j in {j for x in sets[i] for j in index.get(x, ())}:
            if len(sets[i] & sets[j]) >= Fraction(3, 4) * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        for x in sets[i]:
            index.setdefault(x, []).append(i)
    assert {r.doc_id for r in three.collect()} == {i for i in ids if root[i] == i}

    four = stages["decontaminate"](spark, three, data).cache()
    items = [re.sub(r"\s+", " ", r.text.lower()) for r in read(spark, data, "benchmark").collect()]
    left = {r.doc_id for r in four.collect()}
    leaky = {r.doc_id for r in three.collect() if any(x in re.sub(r"\s+", " ", r.text.lower()) for x in items)}
    assert left == {r.doc_id for r in three.collect()} - leaky and four.columns == columns

    five = stages["packing"](spark, four, data).collect()
    library = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    want = {i: len(library.encode(before[i] or "", add_special_tokens=False).ids) + 1 for i in left}
    got: Counter = Counter()
    for r in five:
        got[r.doc_id] += r.length
    assert got == want


def test_run_and_empty(spark, data):
    assert corpus_pipeline.run(spark, data).filter(F.col("length") > 0).count() > 0
    none = read(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0


def test_stages_decide_by_row(spark, data):
    from .conftest import prose

    rng = random.Random(8)
    a, b, c = (prose(rng, 80) for _ in range(3))
    item = read(spark, data, "benchmark").orderBy("item_id").first().text
    near = [(5, a), (None, a.upper()), (None, b), (None, b.upper()), (7, c), (7, a + " end")]
    leaky = [(None, f"{c} {item} {c}"), (9, f"{a} {item}"), (9, b)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    got = Counter((r.doc_id, r.text.lower()) for r in stages["jaccard_join"](spark, frame(near), data).collect())
    assert got == Counter([(5, a.lower()), (None, b.lower()), (7, c.lower())])
    got = Counter((r.doc_id, r.text) for r in stages["decontaminate"](spark, frame(leaky), data).collect())
    assert got == Counter([(9, b)])
