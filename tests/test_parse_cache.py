"""The parse cache: nothing is lexed twice, one changed file parses one repository, failures are tried again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomstrata.sources import parse_cache, repository

PACKAGE = b'{"dependencies": {"express": "^4.0"}}'


def tree(spark, change=None):
    rows = [(r, "package.json", PACKAGE) for r in ("a", "b", "c")]
    rows += [(r, f"routes/{k}.js", f"const router = require('express').Router();\nrouter.get('/{r}{k}', (q, s) => {{}});\n".encode()) for r in ("a", "b", "c") for k in range(2)]
    rows = [(r, p, change[r, p] if change and (r, p) in change else c) for r, p, c in rows]
    df = spark.createDataFrame([x for x in rows if x[2] is not None], "repo_name string, path string, content binary").repartition(3)
    return df.withColumn("length", F.length("content").cast("long"))


class Parser:
    """repository.parse() that notes which repositories it got."""

    def __init__(self, failures: int = 0) -> None:
        self.seen, self.failures = [], failures

    def __call__(self, files, framework):
        self.seen.append(sorted(r.repo_name for r in files.select("repo_name").distinct().collect()))
        if len(self.seen) <= self.failures:
            raise OSError("down")
        return repository.parse(files, framework)


def routes(graph):
    return sorted((r.repo_name, r.path) for r in graph["endpoints"].collect())


def test_what_changed_is_parsed(spark, tmp_path):
    path, p = f"file://{tmp_path}/graph", Parser()
    first = parse_cache.parsed_graph(tree(spark), "express", path, parse=p)
    want = [(r, f"/{r}{k}") for r in "abc" for k in range(2)]
    assert routes(first) == want and p.seen == [["a", "b", "c"]]
    assert routes(parse_cache.parsed_graph(tree(spark), "express", path, parse=p)) == want and len(p.seen) == 1
    new = tree(spark, {("b", "routes/1.js"): b"const router = require('express').Router();\nrouter.post('/new', h);\n"})
    assert routes(parse_cache.parsed_graph(new, "express", path, parse=p)) == [("a", "/a0"), ("a", "/a1"), ("b", "/b0"), ("b", "/new"), ("c", "/c0"), ("c", "/c1")]
    gone = tree(spark, {("c", "routes/0.js"): None, ("b", "routes/1.js"): b"const router = require('express').Router();\nrouter.post('/new', h);\n"})
    assert routes(parse_cache.parsed_graph(gone, "express", path, parse=p))[-2:] == [("b", "/new"), ("c", "/c1")]
    assert p.seen[1:] == [["b"], ["c"]]
    part = gone.filter("repo_name = 'a'")
    assert len(routes(parse_cache.parsed_graph(part, "express", path, parse=p))) == 5 and len(p.seen) == 3


def test_failures_are_tried_again(spark, tmp_path):
    path, p = f"file://{tmp_path}/graph", Parser(failures=2)
    assert len(routes(parse_cache.parsed_graph(tree(spark), "express", path, wait=0.01, parse=p))) == 6 and len(p.seen) == 3
    with pytest.raises(OSError, match="down"):
        parse_cache.parsed_graph(tree(spark), "express", path + "2", wait=0.01, parse=Parser(failures=9))


def test_digest_depends_on_paths_contents_and_framework(spark):
    of = lambda rows, f="express": {r.repo_name: r.digest for r in parse_cache.digests(spark.createDataFrame(rows, "repo_name string, path string, content binary"), f).collect()}
    base = of([("a", "x", b"1"), ("a", "y", b"2")])
    assert of([("a", "y", b"2"), ("a", "x", b"1")]) == base
    assert base not in (of([("a", "x", b"2"), ("a", "y", b"1")]), of([("a", "x", b"1")]), of([("a", "x", b"1"), ("a", "y", b"2")], "nestjs"), of([("a", "x", b"1"), ("a", "z", b"2")]))
