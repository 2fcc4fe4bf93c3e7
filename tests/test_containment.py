"""Containment by n-grams against a look at every pair."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from loomstrata.operators import containment, facts


def strings(rng: random.Random, n: int, letters: str, most: int) -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("letters,least", [("ab", 1), ("abcdé日", 1), ("ab/", 4), ("abc", 2)])
def test_against_pairs(spark, letters, least):
    rng = random.Random(letters)
    inner = {(g, s) for g in "xy" for s in strings(rng, 60, letters, 7)} | {("z", "ab")}
    outer = {(g, s) for g in "xy" for s in strings(rng, 40, letters, 14)}
    a = spark.createDataFrame(sorted(inner), "g string, s string")
    b = spark.createDataFrame([*sorted(outer), ("x", None)], "g string, t string")
    pairs = [(g, s, t) for g, s in inner for h, t in outer if g == h and len(s) >= least and s in t]
    assert {tuple(r) for r in containment.lying_in(a, b, ["g"], least).collect()} == {(g, s) for g, s, _ in pairs}
    assert {tuple(r) for r in containment.holding(b, a, ["g"], least).collect()} == {(g, t) for g, _, t in pairs}


def test_no_join_on_the_group_alone(spark):
    a = spark.createDataFrame([("g", "abcdef")], "g string, s string")
    b = spark.createDataFrame([("g", "xabcdefx")], "g string, t string")
    for df in (containment.lying_in(a, b, ["g"]), containment.holding(b, a, ["g"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join" in x]
        assert joins and all("gram" in x for x in joins)


def test_supported_against_the_rule(spark):
    rng = random.Random(8)
    words = [w for w in strings(rng, 300, "abc/@.", 9) if len(w) >= 2]
    known = [(r, w) for r in ("p", "q") for w in rng.sample(words, 40)] + [("p", "abc"), ("p", "bca/")]
    cands = [(r, k, w.upper() if k % 3 else w) for r in ("p", "q", "none") for k, w in enumerate(words)]
    c = spark.createDataFrame(cands, "repo_name string, k long, candidate string")
    got = {(x.repo_name, x.k): x.supported for x in facts.unsupported(c, spark.createDataFrame(known, "repo_name string, known string")).collect()}
    for repo, k, word in cands:
        low, names = word.lower(), {w for r, w in known if r == repo}
        want = low in names or low.lstrip("@") in names or any(low in n or n in low for n in names if len(n) > 3)
        assert got[repo, k] == want, (repo, word)


def test_one_large_repository(spark):
    """20,000 names and as many candidates of one repository, with long common parts: no look at 400 million pairs."""
    n = 20_000
    names = spark.range(n).select(F.lit("r").alias("repo_name"), F.concat(F.lit("/api/v1/resources/item"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("known"))
    wanted = F.when(F.col("id") % 2 == 0, F.concat(F.lit("item"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("")))
    missing = F.concat(F.lit("/api/v1/resources/item9"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("/more"))
    cands = spark.range(n).select(F.lit("r").alias("repo_name"), F.coalesce(wanted, missing).alias("candidate"))
    began = time.time()
    got = {r["supported"]: r["count"] for r in facts.unsupported(cands, names).groupBy("supported").count().collect()}
    assert got == {True: n // 2, False: n // 2}
    assert time.time() - began < 120
