"""Repair of conversation structure: A* on the edit lattice of each conversation.

A node of the lattice is (rows read, state of the role grammar `(s?(ua)+)?`); edits lead from node to node. The heuristic is
a suffix sum, made before the search: each row that has to go charges its deletion, each truncated one the least that either
edit of it costs. It never exceeds what is still to pay and falls by no more than an edit costs, so the frontier, ordered by
(cost plus heuristic, edits so far), closes each node with its cheapest and, of those, ASCII-least edits.

Conversations of up to LONG_ROWS rows and LONG_BYTES of text are streamed through tasks whole, sorted. A longer one is cut
into blocks along its order: A* gives a block's cheapest edits from each state to each, blocks are chained by those, and the
texts follow the chosen edits block by block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, numbered, small_enough, staged, tidy

#: What edits cost, what states accept, blanks.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ACCEPTING, STATES = (0, 3), range(4)
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
#: The state that a kept role's initial leads to, and the one (and its role) that a new user or assistant leads to.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ADDED = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: Beyond these a conversation goes by blocks of at most so many rows and bytes.
LONG_ROWS, LONG_BYTES, BLOCK_ROWS, BLOCK_BYTES = 1000, 4 << 20, 1000, 4 << 20


def search(initials: list[str], faults: list[str], entry: int = 0, exits: tuple[int, ...] = ACCEPTING, every: bool = False) -> dict[int, tuple[int, str]]:
    """By exit state (cost, edits) of the cheapest edits from the entry state over all rows; of the nearest exit alone, or
    of every one that can be reached. faults: 'b' or 'd' (the row has to go), 't' (truncated) or '' for each row."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] in ("b", "d") else min(DELETE, TRUNCATED) if faults[i] == "t" else 0)
    frontier, closed, found = [(ahead[0], "", 0, entry)], set(), {}
    while frontier:
        key, edits, i, state = heapq.heappop(frontier)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and state in exits:
            found[state] = (key, edits)
            if not every or len(found) == len(exits):
                break
        spent = key - ahead[i]
        added = ADDED[state][0]
        steps = [(INSERT, "I", i, added)]
        if i < n:
            steps.append((DELETE, "D", i + 1, state))
            if faults[i] not in ("b", "d"):
                charge = TRUNCATED if faults[i] == "t" else 0
                steps.append((REROLE + charge, "R", i + 1, added))
                if (state, initials[i]) in STEP:
                    steps.append((KEEP + charge, "K", i + 1, STEP[state, initials[i]]))
        for cost, edit, j, to in steps:
            if (j, to) not in closed:
                heapq.heappush(frontier, (spent + cost + ahead[j], edits + edit, j, to))
    return found


def replay(edits: str, rows: list[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The (role, text) of the repaired rows."""
    left = iter(rows)
    for edit in edits:
        if edit == "I":
            state, role = ADDED[state]
            yield role, ""
            continue
        role, text = next(left)
        if edit == "K":
            state = STEP[state, role[:1]]
        elif edit == "R":
            state, role = ADDED[state]
        if edit != "D":
            yield role, text


def damaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows after the damage that the CRC-32 of conv:turn decides on (a null is one space there, as in role and text).
    A dropped row stays with alive = false, so that its conversation isn't lost."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(word(text_col), ".!?", "")).otherwise(word(text_col))
    rows = df.select(
        F.col(conv_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(word(role_col)).alias("role"),
        text.alias("text"),
        (kind != 0).alias("alive"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def plain(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows as they are, nulls as in damaged()."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turn = F.col(turn_col).cast("long").alias("turn")
    return df.select(F.col(conv_col).alias("id"), turn, word(role_col).alias("role"), word(text_col).alias("text"), F.lit(True).alias("alive"))


def _with_faults(rows: DataFrame) -> DataFrame:
    """key: the id as a string that is never null; fault: 'b' for blank, 't' for truncated, else empty."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    return rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))).withColumn("fault", fault)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS = "array<struct<role:string,text:string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _whole(rows: list[tuple]) -> dict:
    """Facts, edits and repaired turns of a conversation; rows of (id, turn, role, text, alive, fault), in order."""
    live = [r[1:4] + r[5:] for r in rows if r[4]]
    seen, faults = set(), []
    for _, role, text, fault in live:
        faults.append("d" if not fault == "b" and (role, text) in seen else fault)
        seen.add((role, text))
    initials = [r[1][:1] for r in live]
    turns = {r[0] for r in live} - {None}
    cost, audit = min(search(initials, faults).values()) if live else (0, "")
    return {
        "id": rows[0][0],
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "illegal": _illegal(initials),
        "cost": cost,
        "audit": audit,
        "turns": [{"role": a, "text": b} for a, b in replay(audit, [r[1:3] for r in live])],
    }


def _short(rows: DataFrame) -> DataFrame:
    """One row a conversation, from sorted partitions that hold whole ones."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("key", "id", "turn", "role", "text", "alive", "fault").repartition("key").sortWithinPartitions("key", "turn", "role", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, size, id_type = None, [], [], 0, None

        def batch() -> pa.RecordBatch:
            types = {"id": id_type, "audit": pa.string(), "turns": _TURNS}
            return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in out], types.get(c, pa.int64())) for c in ("id", *FACTS, "audit", "turns")})

        for b in batches:
            id_type = b.schema.field("id").type
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if k != key and held:
                    out.append(_whole(held))
                    size += sum(len(r[3]) for r in held) + 100
                    held = []
                    if size >= 1 << 20:
                        yield batch()
                        out, size = [], 0
                key = k
                held.append(tuple(row))
        if held:
            out.append(_whole(held))
        if out:
            yield batch()

    return dealt.mapInArrow(tidy(each), f"id {kind}, {', '.join(f'{c} long' for c in FACTS)}, audit string, turns {TURNS}")


# --- long conversations -------------------------------------------------------------------------------------------------

BLOCK = "part long, block long"
CELLS = "array<struct<entry:int,exit:int,cost:long,edits:string>>"


def _blocks(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """The live rows in order, staged with (part, block, at) of each; the last row of a block has the block's summary."""
    spark = rows.sparkSession
    rows = numbered(rows)
    same = ["key", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), F.col(ROW).alias("c"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("place", place)
    first = staged(rows.groupBy(*same).agg(F.min("place").alias("first")), "first_rows")
    rows = rows.join(first, same)
    fault = F.when((F.col("fault") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("fault"))
    order = ["key", "turn", "role", "text", ROW]
    rows = rows.withColumn("fault", fault).select("key", "turn", "role", "text", "fault", ROW)
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("turn", ROW)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            initials, faults, n = [r[1][:1] for r in held], [r[3] for r in held], len(held)
            ways = [(a, b, *found) for a in STATES for b, found in search(initials, faults, a, tuple(STATES), True).items()]
            cells = [dict(zip(("entry", "exit", "cost", "edits"), way)) for way in ways]
            inside = {"first": initials[0], "last": initials[-1], "illegal": _illegal(initials)} | {f: faults.count(f) for f in "bdt"}
            end = {c: pa.array([None] * (n - 1) + [v], pa.string() if c in ("first", "last") else pa.int64()) for c, v in inside.items()}
            cell = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
            at = {"part": pa.array([part] * n, pa.int64()), "block": pa.array([block] * n, pa.int64()), "at": pa.array(range(n), pa.int64())}
            own = {c: pa.array([r[i] for r in held], pa.string()) for i, c in enumerate(("key", "role", "text"))}
            return pa.RecordBatch.from_pydict(own | at | end | {"cells": pa.array([None] * (n - 1) + [cells], cell)})

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[0] != held[-1][0] or len(held) >= block_rows or size >= block_bytes):
                    yield done()
                    block, held, size = block + 1, [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield done()

    summary = f"first string, last string, illegal long, b long, d long, t long, cells {CELLS}"
    return staged(dealt.mapInArrow(tidy(each), f"key string, role string, text string, {BLOCK}, at long, {summary}"), "blocks")


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """A row for each block of a conversation: the state it begins in and its edits in the cheapest whole."""
    group = group.sort_values(["part", "block"])
    best = {0: (0, "", None)}  # by state: cost, edits, and the chain of (entry, edits of the block)
    illegal, last = 0, None
    for r in group.itertuples(index=False):
        illegal += int(r.illegal) + (last is not None and last + r.first not in LEGAL)
        last = r.last
        after: dict[int, tuple] = {}
        for cell in r.cells:
            if cell["entry"] in best:
                cost, edits, chain = best[cell["entry"]]
                new = (cost + cell["cost"], edits + cell["edits"], (cell["entry"], cell["edits"], chain))
                if cell["exit"] not in after or new[:2] < after[cell["exit"]][:2]:
                    after[cell["exit"]] = new
        best = after
    cost, _, chain = min((best[s] for s in ACCEPTING if s in best), key=lambda x: x[:2])
    states, pieces = [], []
    while chain is not None:
        states.append(chain[0])
        pieces.append(chain[1])
        chain = chain[2]
    return group[["key", "part", "block", "b", "d", "t"]].assign(entry=states[::-1], edits=pieces[::-1], cost=cost, illegal=illegal)


def _block_turns(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    made = list(replay(chosen["edits"].iloc[0], list(zip(rows["role"], rows["text"])), int(chosen["entry"].iloc[0])))
    out = pd.DataFrame(made, columns=["role", "text"])
    return out.assign(key=rows["key"].iloc[0], part=rows["part"].iloc[0], block=rows["block"].iloc[0], at=range(len(made)))[["key", "part", "block", "at", "role", "text"]]


@dataclass
class Repaired:
    """conversations: one row each (id, facts, cost, audit, turns); turns is null for a long conversation, whose repaired
    turns are rows of long_turns (key, part, block, at, role, text), ordered by (part, block, at). long_turns is None where
    there are none."""

    conversations: DataFrame
    long_turns: DataFrame | None


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> Repaired:
    """The cheapest repair of every conversation of rows, as damaged() or plain() give them.

    Rows are taken by (turn, nulls first; role; text). A null id is a conversation of its own; repeated rows are duplicates.
    Roles other than s..., u... and a... can't be kept. A conversation without live rows, or whose rows all have to go, has
    no turns; an empty table gives no conversations.
    """
    rows = _with_faults(rows)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("id").alias("id"))
    long = staged(sizes.filter((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select("key", "id"), "long_conversations")
    if long.isEmpty():
        return Repaired(_short(rows), None)
    chosen_keys = F.broadcast(long.select("key")) if small_enough(long) else long.select("key")
    short = _short(rows.join(chosen_keys, "key", "left_anti"))
    live = rows.filter("alive").join(chosen_keys, "key", "left_semi")
    blocks = _blocks(live, block_rows, block_bytes)
    ends = blocks.filter(F.col("cells").isNotNull()).drop("role", "text", "at")
    chosen = staged(ends.groupBy("key").applyInPandas(_chain, f"key string, {BLOCK}, b long, d long, t long, entry long, edits string, cost long, illegal long"), "chosen")
    where = ["key", "part", "block"]
    cut = blocks.select(*where, "at", "role", "text").groupBy(*where).cogroup(chosen.select(*where, "entry", "edits").groupBy(*where))
    turns = staged(cut.applyInPandas(_block_turns, f"key string, {BLOCK}, at long, role string, text string"), "long_turns")
    numbers = live.select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    edits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "edits"))), lambda x: x["edits"]), "")
    sums = [F.sum(c).alias(name) for c, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    total = chosen.groupBy("key").agg(*sums, F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), edits.alias("audit"))
    facts = long.join(numbers, "key", "left").join(total, "key", "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in FACTS]
    out = facts.select("id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.lit(None).cast(TURNS).alias("turns"))
    return Repaired(short.unionByName(out), turns)


def _text_hash(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of long conversations: their texts pass one by one, in order, through one hash."""
    dealt = turns.repartition("key").sortWithinPartitions("key", "part", "block", "at").select("key", "role", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, hashlib.sha256()
        one = lambda: pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [h.hexdigest()]})
        for b in batches:
            for k, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        yield one()
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        if key is not None:
            yield one()

    return dealt.mapInArrow(tidy(each), "key string, repaired_sha256 string")


def digest(found: Repaired, conv_col: str = "conv_id") -> DataFrame:
    """conversations with repaired_sha256 in place of the turns: of `role:text` of all, joined by newlines."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    out = found.conversations.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256))
    if found.long_turns is not None:
        hashes = staged(_text_hash(found.long_turns), "long_hashes")
        key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
        out = out.withColumn("key", key).withColumnRenamed("repaired_sha256", "whole").join(F.broadcast(hashes) if small_enough(hashes) else hashes, "key", "left")
        out = out.withColumn("repaired_sha256", F.coalesce("whole", "repaired_sha256", F.sha2(F.lit(""), 256)))
    return out.select(F.col("id").alias(conv_col), *FACTS, "audit", "repaired_sha256")


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **limits) -> DataFrame:
    """digest() of the repaired conversations of df after damaged()."""
    return digest(repair(damaged(df, conv_col, turn_col, role_col, text_col), **limits), conv_col)
