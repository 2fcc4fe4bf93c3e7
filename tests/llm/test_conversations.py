"""Conversation repair: A* against exhaustive and plain shortest paths, blocks against whole conversations, odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomstrata.llm import conversations, queries
from loomstrata.llm.common import read

GRAMMAR = re.compile(r"(s?(ua)+)?")
CHARGE = {"K": 0, "R": 2, "D": 3, "I": 2}


def walk(edits: str, rows: list[tuple[str, str]]) -> list[str] | None:
    """Initials after the edits, roles of new ones as the grammar needs them; None where it can't be."""
    out, i = "", 0
    for e in edits:
        wants = "a" if out[-1:] == "u" else "u"
        if e == "I":
            out += wants
            continue
        if i == len(rows) or (e in "KR" and rows[i][1] in ("b", "d")):
            return None
        out += {"K": rows[i][0], "R": wants, "D": ""}[e]
        i += 1
    return out if i == len(rows) and GRAMMAR.fullmatch(out) else None


def price(edits: str, rows: list[tuple[str, str]]) -> int:
    kept = [e for e in edits if e != "I"]
    return sum(CHARGE[e] for e in edits) + sum(e != "D" and f == "t" for e, (_, f) in zip(kept, rows))


def plain_repair(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, edits) by relaxing every node's best value until nothing changes. rows: (initial, fault)."""
    step, added = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}, {"": "u", "s": "u", "u": "a", "a": "u"}
    layer = {"": (0, "")}
    for row in [*rows, None]:
        for _ in range(4):
            for s, (c, e) in list(layer.items()):
                new = (c + 2, e + "I")
                layer[added[s]] = min(layer.get(added[s], new), new)
        if row is None:
            break
        nxt: dict[str, tuple[int, str]] = {}
        for s, (c, e) in layer.items():
            ways = [(s, 3, "D")]
            if row[1] not in ("b", "d"):
                extra = row[1] == "t"
                ways += [(added[s], 2 + extra, "R")] + ([(step[s, row[0]], 0 + extra, "K")] if (s, row[0]) in step else [])
            for to, cost, edit in ways:
                nxt[to] = min(nxt.get(to, (c + cost, e + edit)), (c + cost, e + edit))
        layer = nxt
    return min(layer[s] for s in ("", "a") if s in layer)


def plain_query(rows: list[tuple]) -> set[tuple]:
    """The contract, row by row. rows: (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, live in groups.items():
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in live:
            inked = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not inked else "d" if (role, text) in seen else "t" if inked[-1] not in ".!?" else "")
            seen.add((role, text))
        cells = [(r[1][:1], f) for r, f in zip(live, faults)]
        cost, edits = plain_repair(cells)
        lines, i, state = [], 0, ""
        for e in edits:
            wants = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{wants}:")
                state = wants[0]
                continue
            if e != "D":
                role = live[i][1] if e == "K" else wants
                lines.append(f"{role}:{live[i][2]}")
                state = role[0]
            i += 1
        turns = {r[0] for r in live} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[0] + b[0] for a, b in zip(cells, cells[1:])]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.add((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, sha))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_search_against_every_edit_string():
    for n in range(4):
        for rows in itertools.product(itertools.product("suax", ("", "t", "d")), repeat=n):
            if n == 3 and random.Random(str(rows)).random() > 0.1:
                continue
            fits = [(price(e, rows), e) for k in range(n + 3) for e in map("".join, itertools.product("DIKR", repeat=k)) if walk(e, rows) is not None]
            (best,) = conversations.search([r[0] for r in rows], [r[1] for r in rows]).values()
            assert best == min(fits) == plain_repair(list(rows))


def test_search_against_relaxation():
    rng = random.Random(2)
    for n in (5, 20, 200):
        for _ in range(30):
            rows = [(rng.choice("ssuuuaaax"), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(n)]
            (best,) = conversations.search(*map(list, zip(*rows))).values()
            assert best == plain_repair(rows)


def test_registered(spark, data):
    rows = [tuple(r) for r in read(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, data)
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == plain_query(rows)


@pytest.fixture(scope="module")
def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    texts = [None, "", "a.", "b", "c!", "d?", "e", "f.\n ", " ", "\x0b\x0c", "g ", "日本。", "x" * 5000]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    ids = [None, *range(40)]
    rows = [(rng.choice(ids), rng.choice([None, -5, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    return [*rows, *rows[:30], *((7, i, "user" if i % 3 else "assistant", f"line {i}.") for i in range(300))]


def test_odd_rows_whole_and_by_blocks(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string").repartition(4)
    df = df.select("*", *(F.lit("x").alias(c) for c in ("id", "key", "fault", "alive", "part", "block", "at", "cost")))
    want = plain_query(odd_rows)
    assert {tuple(r) for r in conversations.repair_conversations(df).collect()} == want
    assert {tuple(r) for r in conversations.repair_conversations(df, long_rows=8, block_rows=7).collect()} == want
    assert {tuple(r) for r in conversations.repair_conversations(df, long_bytes=900, block_bytes=300).collect()} == want


def test_turns(spark):
    rows = [("c", 0, "system", "Be brief."), ("c", 1, "assistant", "Hi."), ("c", 2, "assistant", "Yes."), ("c", 3, "user", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    (got,) = conversations.repair(conversations.plain(df, "conv_id", "turn", "role", "text")).conversations.collect()
    assert (got.cost, got.audit) == (5, "KRKD")
    assert [tuple(t) for t in got.turns] == [("system", "Be brief."), ("user", "Hi."), ("assistant", "Yes.")]


def test_empty(spark, odd_rows):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_conversations(df).collect() == []
