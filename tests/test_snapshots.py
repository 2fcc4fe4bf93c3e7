"""Graph snapshots: whole writes or none, repositories that lose rows, writers at the same time."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from loomstrata.sources import snapshots


def graph(spark, modules, endpoints):
    return {
        "modules": spark.createDataFrame(modules, "repo_name string, id string, path string"),
        "endpoints": spark.createDataFrame(endpoints, "repo_name string, id string"),
    }


def rows(spark, path):
    return {name: sorted(map(tuple, t.collect())) for name, t in snapshots.read_graph(spark, path).items()}


@pytest.fixture()
def path(spark, tmp_path):
    out = f"file://{tmp_path}/graph"
    snapshots.write_graph(graph(spark, [("a", "m0", "x.js"), ("b", "m0", "y.js")], [("a", "e0"), ("b", "e0"), ("b", "e1")]), out)
    return out


def test_parsed_again_loses_rows(spark, path):
    """Repository b has another module and no endpoints now; a stays."""
    assert snapshots.write_graph(graph(spark, [("b", "m1", "z.js")], []), path) == 1
    assert rows(spark, path) == {"modules": [("a", "m0", "x.js"), ("b", "m1", "z.js")], "endpoints": [("a", "e0")]}
    snapshots.write_graph({"modules": graph(spark, [("a", "m9", "x.js")], [])["modules"]}, path)
    assert rows(spark, path) == {"modules": [("a", "m9", "x.js"), ("b", "m1", "z.js")], "endpoints": []}


def test_failure_between_tables(spark, path):
    before = rows(spark, path)
    new = graph(spark, [("b", "m1", "z.js"), ("c", "m0", "c.js")], [("b", "e7")])
    new["endpoints"] = new["endpoints"].withColumn("id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        snapshots.write_graph(new, path)
    assert rows(spark, path) == before
    assert any(x.startswith("modules/version=") for x in snapshots.vacuum(spark, path))
    assert rows(spark, path) == before


def test_readers_keep_their_snapshot(spark, path):
    tables = snapshots.read_graph(spark, path)
    snapshots.write_graph(graph(spark, [("b", "m1", "z.js")], []), path)
    assert sorted(r.id for r in tables["endpoints"].collect()) == ["e0", "e0", "e1"]


def test_another_writer_was_first(spark, path, monkeypatch):
    """The log number is taken between a writer's look and its entry: its manifest is made again on top of the other's."""
    put = snapshots._Folder.put_new
    calls = []

    def late(self, name, text):
        calls.append(name)
        if len(calls) == 1:
            snapshots.write_graph(graph(spark, [("c", "m0", "c.js")], [("c", "e0")]), path)
        return put(self, name, text)

    monkeypatch.setattr(snapshots._Folder, "put_new", late)
    assert snapshots.write_graph(graph(spark, [("a", "m5", "x.js")], []), path) == 2
    assert rows(spark, path) == {"modules": [("a", "m5", "x.js"), ("b", "m0", "y.js"), ("c", "m0", "c.js")], "endpoints": [("b", "e0"), ("b", "e1"), ("c", "e0")]}


def test_entry_is_never_replaced(spark, path, tmp_path):
    folder = snapshots._Folder(spark, path)
    assert not folder.put_new(f"{snapshots.LOG}/{0:012d}.json", "{}")
    assert json.load(open(tmp_path / "graph/_log/000000000000.json"))["versions"]
    assert not [f for f in os.listdir(tmp_path / "graph/_log") if "draft" in f and not f.endswith(".crc")]


def test_compact_and_vacuum(spark, path):
    for k in range(3):
        snapshots.write_graph(graph(spark, [("b", f"m{k}", "z.js")], [("b", "e")]), path)
    before = rows(spark, path)
    assert len(snapshots.current(spark, path).versions) == 2
    snapshots.compact(spark, path)
    snapshots.vacuum(spark, path)
    assert rows(spark, path) == before and len(snapshots.current(spark, path).versions) == 1
    assert snapshots.read_graph(spark, path + "-none") == {}


def test_rows_without_a_repository(spark, path):
    with pytest.raises(Exception, match="without repo_name"):
        snapshots.write_graph(graph(spark, [(None, "m", "x.js")], []), path)


def test_new_columns(spark, path):
    wide = graph(spark, [("c", "m0", "c.js")], [])
    wide["modules"] = wide["modules"].withColumn("kind", F.lit("router"))
    snapshots.write_graph(wide, path)
    got = {r.repo_name: r.kind for r in snapshots.read_graph(spark, path)["modules"].collect()}
    assert got == {"a": None, "b": None, "c": "router"}
