"""Queries with SQL over small tables where cuts fall in odd places."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from loomstrata.operators import overlap
from loomstrata.sources import repository


def compare(spark, folder, name: str, **tables) -> int:
    """Writes tables and compares a query over them with its SQL; the number of rows."""
    db = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(folder))
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert sorted(got.columns) == sorted(columns)
    found = plain(map(tuple, got.select(*columns).collect()))
    assert found == plain(want.fetchall())
    return len(found)


def test_budget_that_ends_within_a_header(spark, tmp_path):
    """A file counts as soon as it begins, also with half a header; header lines in texts are no files; a null id is last."""
    cut = [("cut", 1, "x" * (24_000 - 13 - 1 - 8)), ("cut", 2, "y"), ("cut", 3, "z")]
    rows = [*cut, ("marked", 7, "a\n// ---- 12 ----\nb"), ("marked", 8, ""), ("nulls", None, "no id"), ("nulls", 5, "w" * 30_000), ("nulls", 6, None)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string")
    assert compare(spark, tmp_path, "raw_context_budget", documents=docs) == 3


def test_more_sources_than_a_parser_takes(spark, tmp_path, monkeypatch):
    """The scan, and queries whose SQL has every file, aren't cut at the parsers' limit."""
    monkeypatch.setattr(repository, "MOST_FILES", 2)
    parts = spark.createDataFrame([(k, f"Brand#{k % 2}", 5) for k in range(9, 90, 9)] + [(16, None, 5)], "p_partkey long, p_brand string, p_size int")
    assert compare(spark, tmp_path / "scan", "scanned_files", part=parts) == 10
    suppliers = spark.createDataFrame([(k, 1) for k in range(1, 6)], "s_suppkey long, s_nationkey int")
    nations = spark.createDataFrame([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int")
    assert compare(spark, tmp_path / "modules", "express_modules", supplier=suppliers, nation=nations) == 11


def test_overlap_of_odd_turns(spark, tmp_path):
    """Empty, blank, missing and repeated turns, texts of one word over and over, and words on one side only."""
    long = " ".join(f"w{k * k % 97}" for k in range(2_000))
    said = ["a b c d e", "a b c d e", "", " \t ", None, "x", "X x", "b a b a b a", "a " * 700, "a " * 300 + "b", long, long[::-1], "É é ｘ　ｙ", "é É"]
    rows = [(1, k, t) for k, t in enumerate(said)] + [(1, 3, "zz"), (2, 5, "a"), (None, 0, "a"), (None, 1, "a"), (3, None, "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    assert compare(spark, tmp_path, "overlap_counts", conversations=turns) == len(said) - 3


@pytest.mark.parametrize("name, exchanges", [("text_overlap", 0), ("overlap_counts", 3)])
def test_overlap_sends_no_tokens(spark, data, name, exchanges):
    """A pair of texts is scored in its row: only rows are sent, to find the pairs."""
    if name == "text_overlap":
        pairs = spark.createDataFrame([(1, "a b", "b a")], "k long, t string, r string")
        out = overlap.overlap_scores(pairs, ["k"], "t", "r")
    else:
        out = entry.queries()[name](spark, data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= exchanges and "Generate" not in plan
