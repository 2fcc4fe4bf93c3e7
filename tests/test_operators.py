"""Operators on small hand-made tables."""

from __future__ import annotations

import json
import math
import random
import time
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstrata import model
from loomstrata.functions import special, text
from loomstrata.operators import context, facts, graph, judge, statistics
from loomstrata.plans import lifecycle
from loomstrata.sources import providers, repository, results

from . import plain_overlap


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda name, rows: spark.createDataFrame(rows, model.TABLES[name].names and model.TABLES[name]).cache()
    out = {}
    base = {
        "repositories": [dict(repo_name="r", detected_language="javascript", detected_framework="Express", framework_version="^4.18.0")],
        "modules": [dict(repo_name="r", id="m0", path="app.js", kind="module", pos=0), dict(repo_name="r", id="m1", path="services/user.js", kind="module", pos=1)],
        "classes": [dict(repo_name="r", id="c0", name="UserService", module_id="m1", implements_raw=["c1"], is_interface=False, pos=0), dict(repo_name="r", id="c1", name="BaseService", module_id="m1", implements_raw=[], is_interface=True, pos=1)],
        "functions": [dict(repo_name="r", id="f0", name="createUser", module_id="m1", class_id="c0", calls=["f1"], is_api_handler=True)],
        "endpoints": [dict(repo_name="r", id="e0", method="POST", path="/users", handler_function_id="f0", pos=0), dict(repo_name="r", id="e1", method="GET", path="/users/:id", handler_function_id=None, pos=1)],
        "db_entities": [dict(repo_name="r", id="d0", name="User", source_path="services/user.js", related_function_ids=["f0"], pos=0)],
        "import_edges": [dict(repo_name="r", from_module_id="m0", to_module_id="m1"), dict(repo_name="r", from_module_id="m0", to_module_id="m1"), dict(repo_name="r", from_module_id="m0", to_module_id="gone")],
        "external_deps": [dict(repo_name="r", name="express", version="^4.18.0", dep_type="runtime", pos=0)],
        "config_files": [dict(repo_name="r", path="package.json", config_type="build")],
    }
    for name, rows in base.items():
        both = rows + [dict(x, repo_name="r-b") for x in rows]
        out[name] = make(name, [tuple(x.get(c) for c in model.TABLES[name].names) for x in both])
    return out


def test_contexts(tables):
    view = graph.dependency_view(tables["modules"], tables["import_edges"], tables["external_deps"])
    dep = {r[0]: r[1] for r in context.dependency_text(view).collect()}
    assert dep["r"] == "Module dependency graph:\n- app.js imports: services/user.js\n- services/user.js imports: (none)\n\nExternal dependencies: express" and dep["r-b"] == dep["r"]
    names = ("repositories", "modules", "import_edges", "classes", "endpoints", "functions", "external_deps", "config_files", "db_entities")
    kg = {r[0]: r[1] for r in context.knowledge_text(graph.knowledge_view(*(tables[n] for n in names))).collect()}["r"]
    assert "    defines: BaseService, UserService" in kg and "- POST /users -> createUser" in kg and "- GET /users/:id -> (inline" in kg and kg.startswith("Framework: Express (^4.18.0)")
    rows = graph.diagram_rows(tables["modules"], tables["import_edges"], tables["endpoints"], tables["functions"])
    m = {r[0]: r[1] for r in context.mermaid(rows, tables["repositories"]).collect()}["r"]
    assert m.split("\n")[0] == "graph TD" and '  e0{{"POST /users"}}\n  m1 -.-> e0' in m and m.count("-->") == 1
    with pytest.raises(ValueError):
        context.build_context("raw", view, view)
    counts = graph.entity_counts(tables).filter("repo_name = 'r'").first()
    assert (counts.modules, counts.classes, counts.api_endpoints) == (2, 2, 2)


def test_raw_text(spark):
    files = spark.createDataFrame([("r", 0, "a", "x" * 10), ("r", 1, "b", None), ("r", 2, "c", "y" * 30), ("r", 3, "d", "z")], "repo_name string, pos int, path string, text string")
    got = context.raw_text(files, [F.col("pos")], budget=50).first().context
    first = "// ---- a ----\n" + "x" * 10
    assert got == first + "\n\n" + ("// ---- c ----\n" + "y" * 30)[: 50 - len(first)]


def test_upsert_is_idempotent(spark):
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", None, 1)], "k string, v int, at int")
    once = graph.upsert(None, new, ["k"], [F.col("at")])
    twice = graph.upsert(once, new, ["k"], [F.col("at")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 2, 2), ("b", None, 1)]
    assert not graph.duplicates(once, ["k"]).collect() and graph.duplicates(new, ["k"]).first().n == 2


def test_mount_cycle(spark):
    own = spark.createDataFrame([("r", "c", "own")], "repo_name string, id string, own_prefix string")
    mounts = spark.createDataFrame([("r", "a", "b", "x"), ("r", "b", "a", "y"), ("r", "c", "a", "z")], "repo_name string, id string, mounter string, local_prefix string")
    got = {r.id: r.prefix for r in graph.mount_prefixes(own, mounts).collect()}
    assert got["a"] == "/y/x" and got["c"] == "/y/x/z/own"


@pytest.mark.parametrize(
    ("fact", "summary", "rule"),
    [
        ("Framework: Express 4.18", "An express app", "framework_name"),
        ("Framework: Express 4.18", "expressive", None),
        ("Language: typescript", "in ts.", "language_abbrev"),
        ("Dependency: @nestjs/core", "uses @nestjs/core!", "dep_exact"),
        ("Dependency: @nestjs/core", "nestjs has a core", "dep_scope_and_sub"),
        ("Dependency: @nestjs/core", "nestjs only", None),
        ("Dependency: a.b+c", "see a.b+c", "dep_exact"),
        ("Dependency: a.b+c", "see axb+c", None),
        ("Endpoint: GET /users/:id", "`GET /users/{id}/` works", "endpoint_method_path"),
        ("Endpoint: GET /users/:id", "POST then /users/42", "endpoint_path_only"),
        ("Endpoint: GET /users/:id", "/usersx/42", None),
        ("Endpoint: GET /users/:id", None, None),
        ("Class/Service: UserService", "the user service", "class_camel_split"),
        ("Class/Service: UserService", "userservice", "class_exact_ci"),
        ("Database entity: User", "many Users", "entity_plural_cs"),
        ("Database entity: User", "a user", None),
    ],
)
def test_match_rules(spark, fact, summary, rule):
    f = spark.createDataFrame([("r", 0, 1, fact)], "repo_name string, section int, pos int, fact string")
    s = spark.createDataFrame([("r", summary)], "repo_name string, summary_text string")
    got = facts.match_facts(f, s).first()
    assert got.rule == rule and got.lenient == (rule is not None)


def test_verdicts(spark):
    f = spark.createDataFrame([("r", 0, 1, "Framework: Express"), ("r", 3, 1, "Endpoint: GET /tasks"), ("r", 3, 2, "Endpoint: GET /tasks")], "repo_name string, section int, pos int, fact string")
    items = ["get /tasks", "`Endpoint: GET /tasks`", "1", "#2", "fact 9", "12. Framework:  express", "made up"]
    i = spark.createDataFrame([("r", k, x) for k, x in enumerate(items)], "repo_name string, pos int, item string")
    got = {r.pos: r.fact for r in facts.resolve_verdict(i, f, ["repo_name"]).collect()}
    assert got == {0: "Endpoint: GET /tasks", 1: "Endpoint: GET /tasks", 2: "Framework: Express", 3: "Endpoint: GET /tasks", 4: None, 5: "Framework: Express", 6: None}
    raw = spark.createDataFrame([('x {"total_claims": 1, "unsupported_claims": ["a", " ", "b"]} y',), ("none",), ('{"total_claims": "x", "unsupported_claims": []}',)], "t string")
    out = [r[0] for r in raw.select(facts.hallucination_verdict(F.col("t"))).collect()]
    assert (out[0].total, out[0].unsupported) == (2, ["a", "b"]) and out[1] is None and out[2] is None
    assert [r[0] for r in raw.select(text.without_fence(F.lit('```json\n{"a": 1}\n```'))).limit(1).collect()] == ['{"a": 1}']


def test_empty_conventions(spark):
    s = spark.createDataFrame([("r", "text")], "repo_name string, summary_text string")
    none = spark.createDataFrame([], "repo_name string, total_facts long, covered_strict long, covered_lenient long, coverage_strict double, coverage_lenient double")
    assert facts.with_empty(none, s, ["repo_name"]).first().coverage_strict == 1.0
    empty = spark.createDataFrame([], "g string, item string")
    one = spark.createDataFrame([("a", "x"), ("a", "y")], "g string, item string")
    got = statistics.graph_diff(one, one.filter("item = 'x'"), ["g"]).first()
    assert (got.precision, got.recall, got.extra) == (0.5, 1.0, ["y"]) and not statistics.graph_diff(empty, empty, ["g"]).collect()


def test_failure_tags(spark):
    rows = spark.createDataFrame([(["GET /x", "Redis"], ["Endpoint: a", "Odd: b"], "too short", ["Express"], True), (None, None, "a long enough overview that names the express package in its text and more", ["Express"], False)], "unsupported_claims array<string>, missing_facts array<string>, overview string, known_terms array<string>, judged boolean")
    assert [r.tags for r in facts.failure_tags(rows, judged=F.col("judged")).collect()] == [["fabricated_endpoint", "fabricated_technology", "missed_endpoint", "over_generic"], ["malformed_output"]]


def test_statistics(spark):
    rows = spark.createDataFrame([("r1", "m", v, s) for v, s in (("raw", 0.6), ("kg", 0.2))] + [("r2", "m", v, s) for v, s in (("raw", 0.5), ("kg", 0.1))] + [("r3", "m", v, s) for v, s in (("raw", 0.7), ("kg", 0.3))], "repo string, model string, variant string, score double")
    c = {r.variant: r for r in statistics.cell_summary(rows, "score", ["variant"]).collect()}
    assert c["kg"].n == 3 and abs(c["kg"].mean - 0.2) < 1e-9 and abs((c["kg"].ci_high - c["kg"].mean) - 4.302652729911275 * 0.1 / math.sqrt(3)) < 1e-6
    t = statistics.paired_tests(statistics.level_pairs(rows, "score", "variant", ["repo"], ["model"]), ["model", "a", "b"]).first()
    assert (t.a, t.b, t.n_pairs, t.rank_biserial) == ("kg", "raw", 3, -1.0) and t.p_value is not None
    zero = rows.withColumn("score", F.lit(0.5))
    assert statistics.paired_tests(statistics.level_pairs(zero, "score", "variant", ["repo"], ["model"]), ["model", "a", "b"]).first().note == "all differences are zero"
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p_value double")
    assert sorted((r.p_value, round(r.p_holm, 4)) for r in statistics.holm(p).collect() if r.p_value) == [(0.01, 0.03), (0.03, 0.06), (0.04, 0.06)]
    e = statistics.efficiency(spark.createDataFrame([(0.5, 100), (0.5, 0), (0.5, None)], "s double, n int"), "s", "n")
    assert [r.efficiency for r in e.collect()] == [5.0, None, None]
    j = spark.createDataFrame([('{"A": 2}', '["A: x"]'), ("broken", "[]"), ('{"B": 0}', "[]")], "t string, m string")
    assert {r.category: r.coverage for r in statistics.category_coverage(j, "t", "m").collect()} == {"A": 0.5, "B": 1.0}


def test_p_values():
    assert special.wilcoxon_p(np.arange(1, 18.0)) == 2 / 2**17 and special.wilcoxon_p(np.zeros(3)) is None
    x = np.array([1.5, -2, 3, 4, -0.5, 6, 7.25, 8])
    signs = np.array([[1 if k >> i & 1 else -1 for i in range(8)] for k in range(256)])
    ranks = special.average_ranks(np.abs(x))
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    brute = np.mean([min(ranks[s > 0].sum(), ranks[s < 0].sum()) <= w for s in signs])
    assert abs(special.wilcoxon_p(x) - brute) < 1e-12
    assert abs(special.t_quantile(0.975, 10) - 2.2281388519649385) < 1e-8


def test_rank_statistics(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": "a", "k": range(60), "x": rng.integers(0, 9, 60), "y": rng.integers(0, 9, 60)})
    rows = spark.createDataFrame(pdf)
    rho = np.corrcoef(special.average_ranks(pdf.x.to_numpy()), special.average_ranks(pdf.y.to_numpy()))[0, 1]
    assert abs(statistics.spearman(rows, "x", "y", ["g"]).first().rho - rho) < 1e-9
    u = sum((a > b) + 0.5 * (a == b) for a in pdf.x[pdf.k < 30] for b in pdf.x[pdf.k >= 30])
    assert abs(statistics.mann_whitney(rows, "x", F.col("k") < 30, ["g"]).first().u - u) < 1e-9


def test_judge(spark):
    rng = np.random.default_rng(0)
    s = rng.random(300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(4 * s - 2)))).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"m": "a", "confidence": s, "correct": y}))
    got = judge.calibration(rows, ["m"]).first()
    assert -6 < got.a < -2.5 and 1 < got.b < 3 and got.ece < 0.1 and got.skill > 0
    assert judge.calibration(rows.limit(3), ["m"]).first().a is None
    t = spark.createDataFrame([([("Score", -0.1, []), (" 4", -0.2, [("4", math.log(0.6)), ("5", math.log(0.3)), ("x", -1.0)])], ["Score: 2"]), ([], ["score: 2", "Score: 5", "?"]), (None, ["?"])], "tokens array<struct<token:string,logprob:double,top:array<struct<token:string,logprob:double>>>>, samples array<string>")
    out = [(round(r.score, 4), r.method) for r in judge.criterion_score(t).collect()]
    assert out == [(round(4 * 2 / 3 + 5 / 3, 4), "logprob_weighted"), (3.5, "sample_averaged"), (0.0, "unparsed")]
    raw = spark.createDataFrame([('```json\n{"overview": "o", "tech_stack": [], "services": [], "dependencies": []}\n```',), ('{"overview": "o"}',), ("text",)], "r string")
    assert [tuple(r) for r in raw.select(judge.valid_summary(F.col("r")), judge.overview(F.col("r"))).collect()] == [(True, "o"), (False, "o"), (False, "text")]
    c = spark.createDataFrame([("a", [math.log(0.25), math.log(1.0)]), ("b", [])], "k string, logprobs array<double>")
    assert {r.k: r.confidence for r in judge.confidence(c, ["k"]).collect()} == {"a": pytest.approx(0.5), "b": None}


def test_lifecycle(tables):
    def provider(name: str, prompt: str):
        if name == "bad":
            raise RuntimeError("down")
        if "missing_facts" in prompt:
            return json.dumps({"missing_facts": ["1", "nonsense"]}), 10, 5
        if "unsupported_claims" in prompt:
            return '{"total_claims": 4, "unsupported_claims": ["uses Redis"]}', 10, 5
        return '{"overview": "An Express app in javascript with UserService; POST /users makes a User.", "tech_stack": [], "services": [], "dependencies": []}', 100, 20

    with pytest.raises(ValueError):
        lifecycle.scored_ablation(tables, ["w", "j"], "j", provider)
    out = lifecycle.scored_ablation(tables, ["w", "bad"], "j", provider, references=tables["repositories"].select("repo_name", F.lit("An Express application").alias("overview"))).cache()
    rows = sorted(out.collect(), key=lambda r: r.model == "bad")
    assert [r.model for r in rows] == ["w"] * 4 + ["bad"] * 4  # failed runs stay
    assert {(r.status, r.summary_text, r.coverage_strict, r.judge_coverage, tuple(r.tags)) for r in rows[4:]} == {("failed", None, None, None, ("malformed_output",))}
    r = rows[0]
    assert r.total_facts == 8 and r.covered_strict >= 5 and r.judge_hallucination == 0.25 and r.unmatched == 1 and r.missing_facts == ["Framework: Express ^4.18.0"]
    assert "fabricated_technology" in r.tags and 0 < r.rouge_l < 1
    report = lifecycle.report(out)
    assert report["cells"].count() == 2 and {(r.model, r.n, r.succeeded, r.failed) for r in report["runs"].collect()} == {("w", 2, 2, 0), ("bad", 2, 0, 2)}


def test_each_prompt_is_asked_once(tables, tmp_path):
    log = tmp_path / "calls"

    def provider(name: str, prompt: str):
        with open(log, "a") as f:
            f.write(name + prompt[:9].replace("\n", " ") + "\n")
        return '{"overview": "An app.", "missing_facts": [], "total_claims": 1, "unsupported_claims": []}', 1, 1

    out = lifecycle.scored_ablation(tables, ["w", "v"], "j", provider)
    runs = out.collect()
    lifecycle.report(out)["runs"].collect()
    asked = log.read_text().splitlines()
    assert len(runs) == 8 and len(asked) == 3 * len(runs) and sum(x.startswith("j") for x in asked) == 2 * len(runs)


def test_failed_calls_are_rows(spark):
    def down(name: str, prompt: str):
        raise RuntimeError("down")

    r = providers.ask(spark.createDataFrame([("m", "p")], "model string, prompt string"), down, retries=1, backoff=0.01).first()
    assert (r.status, r.retry_count, r.raw_text) == ("failed", 1, None) and "down" in r.error


def test_slow_calls_time_out_and_waits_grow(spark, tmp_path):
    log = tmp_path / "times"

    def slow(name: str, prompt: str):
        import time

        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        if len(open(log).readlines()) < 3:
            time.sleep(30)
        return "late", 1, 1

    began = time.time()
    r = providers.ask(spark.createDataFrame([("m", "p")], "model string, prompt string"), slow, retries=3, timeout=0.3, backoff=0.2).first()
    at = [float(x) for x in log.read_text().split()]
    assert (r.status, r.raw_text, r.retry_count) == ("success", "late", 2) and time.time() - began < 25
    assert at[1] - at[0] > 0.45 and at[2] - at[1] > 0.65


def test_token_calls(spark):
    def raw(name: str, prompt: str):
        if prompt == "x":
            raise ValueError("no")
        return " 4", [(" 4", -0.1, [("4", math.log(0.5)), ("5", math.log(0.25))])]

    rows = providers.ask_tokens(spark.createDataFrame([("m", "p"), ("m", "x")], "model string, prompt string"), raw, retries=0)
    got = {r.prompt: (r.score, r.method) for r in judge.criterion_score(rows.withColumn("samples", F.array().cast("array<string>"))).collect()}
    assert got["p"] == (pytest.approx(13 / 3), "logprob_weighted") and got["x"] == (0.0, "unparsed")


def test_long_mount_chains(spark):
    n = 200
    own = spark.createDataFrame([("r", "n0", "/top/"), ("s", "n5", "x")], "repo_name string, id string, own_prefix string")
    mounts = spark.createDataFrame([("r", f"n{i}", f"n{i - 1}", f"p{i}") for i in range(1, n)] + [("r", "lone", "nowhere", "l")], "repo_name string, id string, mounter string, local_prefix string")
    got = {(r.repo_name, r.id): r.prefix for r in graph.mount_prefixes(own, mounts).collect()}
    assert got == {("r", f"n{i}"): "/".join(["/top", *(f"p{k}" for k in range(1, i + 1))]) for i in range(n)} | {("s", "n5"): "/x", ("r", "lone"): "/l"}


def test_mount_chains_into_cycles(spark):
    """A walk up from each module, which stops before a module that it has seen."""
    up = {"a": "b", "b": "c", "c": "a", "t": "a", "u": "t", "self": "self", "x": "y"}
    mounts = spark.createDataFrame([("r", k, v, k.upper()) for k, v in up.items()], "repo_name string, id string, mounter string, local_prefix string")
    want = {}
    for k in up:
        at, seen, tail = k, [k], ""
        while True:
            tail = "/" + "/".join(x for x in (at.upper() if at in up else "", tail.strip("/")) if x)
            at = up.get(at)
            if at is None or at in seen:
                break
            seen.append(at)
        want[k] = tail
    got = {r.id: r.prefix for r in graph.mount_prefixes(spark.createDataFrame([], "repo_name string, id string, own_prefix string"), mounts).collect()}
    assert got == want


def walk_up(up: dict[str, str], part: dict[str, str]) -> dict[str, str]:
    out = {}
    for k in part:
        at, seen, names = k, set(), []
        while at in part and at not in seen:
            seen.add(at)
            names.append(part[at])
            at = up.get(at)
        out[k] = "/" + "/".join(x for x in reversed(names) if x)
    return out


def test_mount_cycles_of_many_lengths(spark):
    rng = random.Random(5)
    up, n = {}, 0
    for length in (1, 2, 3, 7, 16, 33):
        ring = [f"c{length}_{i:02d}" for i in rng.sample(range(length), length)]
        up |= {a: b for a, b in zip(ring, [*ring[1:], ring[0]])}
        for tail in range(3):
            at = rng.choice(ring)
            for _ in range(rng.randint(1, 40)):
                n += 1
                up[f"t{n}"], at = at, f"t{n}"
    part = {k: rng.choice(["", k, k.upper()]) for k in up}
    mounts = spark.createDataFrame([("r", k, v, part[k]) for k, v in up.items()] + [("q", k, v, part[k]) for k, v in up.items() if "c7" in k], "repo_name string, id string, mounter string, local_prefix string")
    rows = graph.mount_prefixes(spark.createDataFrame([], "repo_name string, id string, own_prefix string"), mounts).collect()
    want = walk_up(up, part)
    assert {r.id: r.prefix for r in rows if r.repo_name == "r"} == want
    assert {r.id: r.prefix for r in rows if r.repo_name == "q"} == {k: v for k, v in want.items() if "c7" in k}


def test_mount_cycle_of_thousands(spark, monkeypatch):
    """5,000 mounts in one cycle: about log(n) rounds of each kind, no round a mount."""
    n, rounds = 5000, []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or write(df, name))
    ids = spark.range(n).select(F.lit("r").alias("repo_name"), F.format_string("n%04d", "id").alias("id"), F.when(F.col("id") % 100 == 0, F.format_string("p%d", "id")).otherwise("").alias("local_prefix"))
    mounts = ids.withColumn("mounter", F.format_string("n%04d", (F.substring("id", 2, 4).cast("long") + 1) % n))
    got = {r.id: r.prefix for r in graph.mount_prefixes(spark.createDataFrame([], "repo_name string, id string, own_prefix string"), mounts).collect()}
    up, part = {f"n{i:04d}": f"n{(i + 1) % n:04d}" for i in range(n)}, {f"n{i:04d}": f"p{i}" if i % 100 == 0 else "" for i in range(n)}
    for i in (0, 1, 99, 100, 4999):
        names, at = [], f"n{i:04d}"
        for _ in range(n):
            names.append(part[at])
            at = up[at]
        assert got[f"n{i:04d}"] == "/" + "/".join(x for x in reversed(names) if x)
    assert len(got) == n and len(rounds) < 60


def test_diagrams_and_unmatched(spark):
    make = lambda rows: spark.createDataFrame(rows, "g string, item string")
    nodes = statistics.graph_diff(make([("a", "x"), ("a", "y"), ("b", "z")]), make([("a", "x"), ("b", "w")]), ["g"])
    edges = statistics.graph_diff(make([("a", "x -> y")]), make([("a", "x -> y")]), ["g"])
    got = {r.g: (r.nodes_f1, r.edges_f1, r.overall_f1) for r in statistics.diagram_f1({"nodes": nodes, "edges": edges}, ["g"]).collect()}
    assert got == {"a": (0.6667, 1.0, 0.8334), "b": (0.0, 1.0, 0.5)}
    report = statistics.diagram_report(spark.createDataFrame([("f", 1.0, 0.5), ("f", 0.0, 0.5)], "framework string, n double, e double"), ["n", "e"], ["framework"])
    assert {(r.field, r.n, r.mean) for r in report.collect()} == {("n", 2, 0.5), ("e", 2, 0.5)}
    rows = spark.createDataFrame([(1, ["1", "2."]), (2, ["GET /x", "1"]), (3, []), (4, None), (5, ["7"])], "k int, unmatched array<string>")
    t = facts.unmatched_totals(rows).first()
    assert (t.n_rows, t.rows_with_any, t.n_items) == (5, 3, 5)
    whole = {r.kind: (r.n, r.estimate) for r in facts.unmatched_composition(rows, ["k"], 10).collect()}
    assert whole == {"index": (4, 4), "fact-like": (1, 1)}
    one = facts.unmatched_composition(rows, ["k"], 1).collect()
    assert sum(r.share for r in one) == pytest.approx(1) and all(r.estimate == int(r.share * 5 + 0.5) for r in one)
    assert [(r.k, r.n_items) for r in facts.all_index_rows(rows, ["k"]).collect()] == [(1, 2), (5, 1)]


def test_text_report(spark, tmp_path):
    t = spark.createDataFrame([("a", 0.5, None), ("bb", 1.0, 3)], "name string, score double, n int")
    text = results.text_report({"first": t, "second": t.limit(0)}, most=1)
    assert text.startswith("== first\nname  score   n\na     0.5000  -\n(1 more rows)\n\n== second")
    results.write_report(spark, {"first": t}, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 5


def test_scores_against_plain_versions(spark, data):
    """The registered queries that SQL can't follow, value by value."""
    from collections import defaultdict

    from loomstrata.plans import queries as plans

    # signed ranks: p of each pair of levels from the differences themselves
    diffs = defaultdict(list)
    for r in plans._level_pairs(spark, data).collect():
        diffs[r.a, r.b].append(float(r.d))
    got = {(r.a, r.b): r for r in plans.paired_tests(spark, data).collect()}
    ps = {k: special.wilcoxon_p(np.array(v)) for k, v in diffs.items()}
    assert got.keys() == ps.keys() and all(got[k].p_value == pytest.approx(p, rel=1e-9) for k, p in ps.items())
    order, top = sorted(ps, key=ps.get), 0.0
    for i, k in enumerate(order):
        top = max(top, min(1.0, (len(order) - i) * ps[k]))
        assert got[k].p_holm == pytest.approx(top, rel=1e-9)

    # rank sums: normal p with ties
    events = spark.read.parquet(f"{data}/events.parquet").select("event_type", "user_id", "value").toPandas()
    for r in statistics.mann_whitney(spark.createDataFrame(events), "value", F.col("user_id") % 2 == 0, ["event_type"]).collect():
        part = events[events.event_type == r.event_type]
        ranks, first = special.average_ranks(part.value.to_numpy()), (part.user_id % 2 == 0).to_numpy()
        _, ties = np.unique(part.value, return_counts=True)
        n1, n2 = first.sum(), (~first).sum()
        u = ranks[first].sum() - n1 * (n1 + 1) / 2
        sd = math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - (ties.astype(float) ** 3 - ties).sum() / ((n1 + n2) * (n1 + n2 - 1))))
        z = (abs(u - n1 * n2 / 2) - 0.5) / sd
        assert r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)

    # bootstraps: means near the normal interval that 10,000 resamples come to
    acct = spark.read.parquet(f"{data}/supplier.parquet").toPandas()
    for r in plans.bootstrap_ci(spark, data).collect():
        v = acct[acct.s_nationkey == r.s_nationkey].s_acctbal.to_numpy()
        rng = np.random.default_rng(0)
        means = v[rng.integers(0, len(v), (20_000, len(v)))].mean(axis=1)
        scale = max(means.std(), 1e-9)
        assert r.mean == pytest.approx(v.mean()) and r.n == len(v)
        assert abs(r.ci_low - np.percentile(means, 2.5)) < 0.25 * scale + 1e-6 and abs(r.ci_high - np.percentile(means, 97.5)) < 0.25 * scale + 1e-6
    for r in plans.bootstrap_rho(spark, data).collect():
        part = acct[acct.s_nationkey == r.s_nationkey]
        if len(part) > 1:
            assert r.rho == pytest.approx(np.corrcoef(*(special.average_ranks(part[c].to_numpy()) for c in ("s_suppkey", "s_acctbal")))[0, 1])

    # calibration: the optimum's gradient is nil, and the scores follow from it
    docs = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    for r in plans.calibration(spark, data).collect():
        part = docs[docs.lang == r.lang]
        s, y = (part.n_chars / (part.n_chars + 2000)).to_numpy(), part.quality.to_numpy(float)
        if r.a is not None and abs(r.a) < 50:
            p = 1 / (1 + np.exp(r.a * s + r.b))
            assert abs((p - y).sum()) < 0.05 and abs(((p - y) * s).sum()) < 0.05
            assert r.brier == pytest.approx(((p - y) ** 2).mean(), abs=2e-6) and r.base_rate == pytest.approx(y.mean(), abs=1e-6)  # six digits

    # overlap: each turn against the one before, by plain versions of all three scores
    turns = spark.read.parquet(f"{data}/conversations.parquet").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).toPandas()
    said = {(r.conv_id, r.turn): r.text for r in turns.itertuples()}
    for r in plans.text_overlap(spark, data).collect():
        h, w = said[r.conv_id, r.turn], said[r.conv_id, r.turn - 1]
        for name in ("bleu4", "rouge_l", "meteor"):
            assert r[name] == (None if h is None or w is None else pytest.approx(getattr(plain_overlap, name)(h, w))), name


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", "m", "raw", "a\n\"b\", c", 3, 0.5)], "repo_name string, model string, context_variant string, summary_text string, latency_ms long, cost double")
    results.write_csv(rows, str(tmp_path / "csv"))
    got = results.read_results(spark, str(tmp_path / "csv"), model.RUNS).first()
    assert (got.summary_text, got.latency_ms, got.cost, got.status) == ("a\n\"b\", c", 3, 0.5, None)
    for _ in range(2):
        results.append_runs(rows, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).filter("run_at is not null").count() == 2
    assert results.to_do(rows, rows, ["repo_name", "model"]).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"metadata": {"name": "r"}, "modules": [{"id": "m", "path": "a.js"}], "dependencies": {"internal": [{"from_module_id": "m", "to_module_id": "m"}], "external": []}}))
    (tmp_path / "p" / "b.json").write_text("{broken")
    t = results.parsed_tables(results.read_json(spark, str(tmp_path / "p"), results.PARSED))
    assert t["modules"].count() == 1 and t["import_edges"].first().from_module_id == "m" and t["classes"].count() == 0


def test_streaming(spark, tmp_path):
    from loomstrata.streaming import runs

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    for n in (2, 3):
        stream = runs.read_runs(spark, str(tmp_path / "in"), rows.schema)
        runs.append_scored(stream, lambda d: d.withColumn("s", F.col("v") * 2), str(tmp_path / "out"), str(tmp_path / "ck"), ["k"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int").write.mode("append").parquet(str(tmp_path / "in"))


def test_kendall_counts_every_pair(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 70 + ["b"] * 40 + ["one"], "k": range(111), "x": rng.integers(0, 9, 111), "y": rng.integers(0, 30, 111)})
    got = {r.g: r for r in statistics.kendall(spark.createDataFrame(pdf), "x", "y", "k", ["g"]).collect()}
    assert set(got) == {"a", "b"}
    for g, r in got.items():
        p = pdf[pdf.g == g].to_numpy()
        pairs = [(int(np.sign(a[2] - b[2])), int(np.sign(a[3] - b[3]))) for i, a in enumerate(p) for b in p[:i]]
        s, nx, ny = sum(a * b for a, b in pairs), sum(a != 0 for a, _ in pairs), sum(b != 0 for _, b in pairs)
        assert (r.score, r.nx, r.ny) == (s, nx, ny) and abs(r.tau - s / math.sqrt(nx * ny)) < 1e-12


def test_whole_tables_are_read(spark, data):
    from loomstrata.plans import queries as plans

    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    pairs = read("lineitem").select("l_partkey", "l_suppkey").distinct().count()
    assert sum(r.classes for r in plans.entity_counts(spark, data).collect()) == pairs
    assert plans.merge_dedup(spark, data).count() == read("customer").count()
    assert plans.kendall(spark, data).count() == read("part").groupBy("p_brand").count().filter("count > 1").count()


def test_agreement_and_criteria(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 4.0), (3.0, 3.0, None), (4.0, 5.0, 1.0)], "a double, b double, c double")
    got = {(r.a, r.b): (r.n, round(r.rho, 4)) for r in statistics.agreement(rows, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (4, 0.8), ("a", "c"): (3, -0.5), ("b", "c"): (3, -1.0)}
    scored = spark.createDataFrame([("x", 4.0, "logprob_weighted"), ("x", 2.0, "sample_averaged"), ("x", 0.0, "unparsed"), ("y", 0.0, "unparsed")], "k string, score double, method string")
    assert {r.k: r.quality for r in judge.mean_criterion(scored, ["k"]).collect()} == {"x": 3.0, "y": None}


def test_database_scan(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(k, f"n{k}", k / 2) for k in range(40)], "k long, name string, v double").write.jdbc(url, "runs")
    got = results.read_database(spark, url, "runs", ["k", "name"], where="k >= 10", key="k", bounds=(0, 40, 4))
    assert got.columns == ["k", "name"] and got.count() == 30 and got.rdd.getNumPartitions() == 4


def test_windows_and_keys_of_a_stream(spark, tmp_path):
    from loomstrata.streaming import runs

    rows = spark.createDataFrame([("a", "2024-01-01 00:01:00", 1.0), ("a", "2024-01-01 00:02:00", 3.0), ("b", "2024-01-01 00:11:00", 5.0), ("a", "2024-01-01 09:00:00", 9.0)], "k string, at string, v double").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name):
        q = make(runs.read_runs(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    first = run(lambda s: runs.once_a_key(s, ["k"], "at"), "firsts")
    assert sorted(r.k for r in first) == ["a", "b"]
    found = {(r.k, r.window.start.minute): (r.n, r.total, r["mean"]) for r in run(lambda s: runs.windowed(s, "at", "10 minutes", ["k"], "v"), "windows") if r.window.start.hour == 0}
    assert found == {("a", 0): (2, 4.0, 2.0), ("b", 10): (1, 5.0, 5.0)}


def test_positions(spark):
    cases = {"7": 7, "#7": 7, "fact 7": 7, "7.": 7, " `No 12)` ": 12, "number7": 7, "item #3.": 3, "fact.4": 4, "'999'": 999, "#.) 7 ).": None, "..7": None, "7...": None, "1000": None, "x7": None, "": None, "fact": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.position_reference(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_far_tail_of_mann_whitney():
    assert 0 < special.mann_whitney_p(0.0, 400, 400, 0.0) < 1e-100


def test_source_files_beyond_the_cap(spark, monkeypatch):
    """The first files by path stay; contents are not in the sort, and the plan cuts each task's ranks."""
    monkeypatch.setattr(repository, "MOST_FILES", 5)
    names = [f"src/f{i:02d}.js" for i in range(12)]
    rows = [(r, p, f"// {r} {p}".encode()) for r in ("a", "b") for p in names] + [("b", "test/x.js", b""), ("c", "one.js", b"1")]
    kept, skipped = repository.source_files(spark.createDataFrame(rows, "repo_name string, path string, content binary"), "express")
    got = sorted((r.repo_name, r.path, r.module_id, bytes(r.content).decode()) for r in kept.collect())
    assert got == [(r, p, f"mod_{i}", f"// {r} {p}") for r in ("a", "b") for i, p in enumerate(names[:5])] + [("c", "one.js", "mod_0", "1")]
    assert [tuple(r) for r in skipped.collect()] == [("b", "test/x.js")]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and not any("Sort" in x and "content" in x and "row_number" in x for x in plan.splitlines())
