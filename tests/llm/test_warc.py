"""The WARC source: archives read by other means, pushed predicates, ranges, commits; the registered query has SQL."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomstrata.llm import queries, warc
from loomstrata.llm.common import read

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def plain(rows: list[tuple]) -> list[tuple]:
    """rows: (page_id, html)."""
    first: dict[bytes, int] = {}
    for i, html in rows:
        raw = (html or "").encode()
        if i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and raw in first and i != first[raw]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def run(df) -> list[tuple]:
    return sorted((tuple(r) for r in warc.archive_pages(df).select(COLUMNS).collect()), key=str)


def test_registered(spark, data):
    rows = [tuple(r) for r in read(spark, data, "pages").select("page_id", "html").collect()]
    got = queries.op13_warc(spark, data)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


@pytest.fixture(scope="module")
def pages() -> list[tuple]:
    rng = random.Random(4)
    body = "".join(rng.choice("abc<>é日\r\n") for _ in range(400))
    rows = [(i, f"http://x/{i % 7} y\r\nWARC-Type: z", rng.choice([body, body[:200], "x" * 99, "x" * 100, "é" * 50, None, "", "WARC/1.1\r\n\r\n"])) for i in range(80)]
    rows += [(None, None, body), (None, "u", "only without an id " * 9), (None, "u", "only without an id " * 9), (3, "u", body), (3, "u", body), (90, "v", "".join(map(chr, range(32, 50_000))) + "tail" * 300_000)]
    return rows


def test_odd_pages(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    df = df.select("*", *(F.lit("x").alias(c) for c in ("id", "sha", "text", "first", "n", "run", "payload", "record_type")))
    assert run(df) == plain([(i, h) for i, _, h in pages])
    assert run(df.limit(0)) == []


def test_other_ids(spark):
    df = spark.createDataFrame([("b/é 1", "u", "x" * 200), ("a%20", "u", "x" * 200)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.archive_pages(df).collect()} == {("a%20", None), ("b/é 1", "a%20")}


@pytest.fixture(scope="module")
def archive(spark, pages, tmp_path_factory) -> str:
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_warc(warc.page_records(df), path, splitBytes=2000, fileBytes=20_000, date="2024-01-02T03:04:05Z")
    return path


def test_archives_are_gzip_members(archive, pages):
    """Any gzip reader gets the records, and lengths in them are right."""
    there = archive.removeprefix("file://")
    names = [f for f in os.listdir(there) if f.endswith(".warc.gz")]
    assert len(names) > 3
    records = 0
    for name in names:
        raw = gzip.open(f"{there}/{name}").read()
        while raw:
            head, rest = raw.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and b"WARC-Date: 2024-01-02T03:04:05Z" in head
            n = int(head.rpartition(b"Content-Length: ")[2])
            assert rest[n : n + 4] == b"\r\n\r\n"
            raw = rest[n + 4 :]
            records += 1
    assert records == len(pages)


def test_ranges_cover_all_records(spark, archive, pages):
    for bytes_, tasks in ((1, 1), (3000, 1), (1 << 30, 4), (1 << 30, 1)):
        got = warc.read_warc(spark, archive, partitionBytes=bytes_, parallelism=tasks)
        assert got.count() == len(pages)
    reader = warc.WarcReader({"path": archive, "partitionBytes": "3000"}, ["record_id"])
    assert len(reader.partitions()) > 5


def test_pushed_predicates(spark, archive):
    """The same rows as without push-down, and payloads of unwanted records are not inflated."""
    everything = spark.createDataFrame(warc.read_warc(spark, archive).collect(), warc.SCHEMA)
    types = ("record_type = 'revisit'", "record_type <> 'revisit'", "target_uri LIKE '%y%' AND record_type = 'response'")
    nulls = ("refers_to IS NULL", "refers_to <=> NULL", "NOT (refers_to = 'urn:page:1')")
    others = ("target_uri LIKE 'http://x/3%'", "target_uri IN ('u', 'v')", "NOT target_uri IN ('u')", "record_id > 'urn:page:5' AND payload_bytes > 100")
    for where in (*types, *nulls, *others):
        got = warc.read_warc(spark, archive).filter(where)
        want = everything.filter(where).drop("headers")  # a map's order isn't kept
        assert sorted(map(str, got.drop("headers").collect())) == sorted(map(str, want.collect())), where
    plan = warc.read_warc(spark, archive).filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")


def test_unwanted_payloads_are_skipped(tmp_path, monkeypatch):
    big = warc.member(warc.record({"record_type": "response", "record_id": "a", "payload": os.urandom(3 << 20)}, "d"))
    small = warc.member(warc.record({"record_type": "revisit", "record_id": "b", "payload_bytes": 7}, "d"))
    (tmp_path / "x.warc.gz").write_bytes(big + small + big)
    seen = []
    more = warc.Record.more
    monkeypatch.setattr(warc.Record, "more", lambda self, n=warc.HEAD: seen.append(len(got := more(self, n))) or got)
    rows = list(warc.scan(f"file://{tmp_path}/x.warc.gz", 0, None, ["record_id", "payload_bytes"], lambda r: r["record_type"] == "revisit"))
    assert rows == [{"record_id": "b", "payload_bytes": 7}] and sum(seen) < 10_000
    seen.clear()
    rows = list(warc.scan(f"file://{tmp_path}/x.warc.gz", 0, None, ["payload_bytes"], lambda r: True))
    assert [r["payload_bytes"] for r in rows] == [3 << 20, 7, 3 << 20] and sum(seen) < 20_000


def test_foreign_archives(spark, tmp_path):
    """Uncompressed files, members without lengths, resource records, folded headers, digests in base32; no commit files."""
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a/\r\nX-Note: one\r\n  two\r\nContent-Type: text/plain\r\nContent-Length: 11\r\n\r\nhello\r\n\r\nwo\r\n\r\n"
    sha1 = b"WARC-Payload-Digest: sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N\r\n"  # of b"hello" it is another
    two = warc.record({"record_id": "q", "payload": b"z" * 500, "payload_digest": "sha256:" + hashlib.sha256(b"z" * 500).hexdigest()}, "d")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "sub/b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "_hidden.warc").write_bytes(b"no archive")
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"hello\r\n\r\nwo"] * 2 + [b"z" * 500] * 2
    assert {r.headers.get("x-note") for r in rows} == {None, "one two"}
    assert warc.read_warc(spark, f"file://{tmp_path}/a.warc", "target_uri string").count() == 2
    (tmp_path / "bad.warc").write_bytes(one.replace(b"X-Note", sha1 + b"X-Note"))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}/bad.warc").collect()
    assert warc.read_warc(spark, f"file://{tmp_path}/bad.warc", verify="false").count() == 1
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(two)[:-30])
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(spark, f"file://{tmp_path}/cut.warc.gz").collect()


def test_commits(spark, tmp_path):
    """Appended archives add up, overwritten ones go, files that no commit lists are never read."""
    path = f"file://{tmp_path}/c"
    one = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    two = spark.createDataFrame([(2, "u", "y"), (3, "u", "z")], one.schema)
    ids = lambda: sorted(r.record_id for r in warc.read_warc(spark, path, "record_id string").collect())
    warc.write_warc(warc.page_records(one), path)
    warc.write_warc(warc.page_records(two), path)
    (tmp_path / "c/left.warc.gz").write_bytes(b"of a task that died")
    assert ids() == ["urn:page:1", "urn:page:2", "urn:page:3"]
    failing = warc.page_records(one).withColumn("payload", F.raise_error(F.lit("lost")).cast("binary"))
    with pytest.raises(Exception, match="lost"):
        warc.write_warc(failing, path, "overwrite")
    assert ids() == ["urn:page:1", "urn:page:2", "urn:page:3"]
    warc.write_warc(warc.page_records(two), path, "overwrite")
    assert ids() == ["urn:page:2", "urn:page:3"]
    commits = [json.load(open(f"{tmp_path}/c/_commits/{f}")) for f in os.listdir(tmp_path / "c/_commits") if f.endswith(".json")]
    assert max(len(c["replaces"]) for c in commits) == 2
