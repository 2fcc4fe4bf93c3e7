"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and a grown shard count moves only the
rows that go to the new shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import restored, shielded, shuffle_partitions, staged, tidy


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key (as unsigned 64 bits), for all keys at once; rounds are few (their mean is ln(shards))."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.full(len(key), -1, np.int64)
    to = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump = (at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        to[live] = jump.astype(np.int64)
        live = live[to[live] < shards]
    return at.astype(np.int32)


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """For every row of df: id_col, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the shard count decide, so shards + 1 takes rows only into its new shard. An id that is
    not an integer is hashed to one first; a null id counts as -1. size is the UTF-8 bytes of the text and one more (null
    text: 1). Slots count from 0 in each shard by (id, text_crc32, size), without gaps; rows that repeat all three get
    neighbouring slots. An empty table gives an empty result. Other columns are not read.

    Slots come without a task that holds a whole shard: rows are range-sorted by id over all tasks, each task numbers the
    rows of each shard, and the counts by (task, shard), at most tasks * shards of them, give where each task begins.
    """
    whole = dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    key = F.coalesce(F.col(id_col).cast("long") if whole else F.xxhash64(id_col), F.lit(-1).cast("long"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["id", "text_crc32", "size"]
    dealt = shielded(rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            shard, slot = jump_hash(b["key"].to_numpy(), shards), np.empty(len(b), np.int64)
            by = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            slot[by] = np.arange(len(b)) - np.repeat(np.cumsum(counts) - counts - seen, counts)
            seen += counts
            yield b.drop(columns="key").assign(shard=shard, slot=slot, grown_shard=jump_hash(b["key"].to_numpy(), shards + 1), part=part)

    kind = rows.schema["id"].dataType.simpleString()
    numbered = staged(dealt.mapInPandas(tidy(number), f"id {kind}, size long, text_crc32 long, no_id boolean, shard int, slot long, grown_shard int, part int"), "slots")
    begins = _begins(numbered)
    return restored(numbered.join(begins, ["part", "shard"]), id_col).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("begin")).alias("slot"), "grown_shard")


def _begins(numbered: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    counts = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("part", "shard", F.coalesce(before, F.lit(0).cast("long")).alias("begin"))
