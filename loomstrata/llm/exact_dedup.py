"""Exact duplicates by a tree-merge of digest runs, in DataFrame functions only.

Every row goes to a run by a hash of its id. A run is a table sorted by digest with one entry for each: the identifier that
stays so far and the number of rows. In each round, a binomial tree of order fan_in sends fan_in neighbouring runs to the
first of them: their entries are range-partitioned by (parent run, digest), merged in that order, and equal neighbours
become one entry in a streaming pass over the merged run, which is written sorted for the next round. After log(runs) /
log(fan_in) rounds one run is left, spread over tasks by ranges of digests. What it found then goes down the tree to the
rows of the first runs. A group of copies has at most one entry a run, so no task or join key gets all its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPREAD, attach, discard, numbered, shuffle_partitions, spread, staged, without_ids

#: An entry's key. The second hash and the length verify the digest: texts that differ in any of them are kept apart.
DIGEST = ["sha", "check", "n_bytes"]


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = SPREAD) -> DataFrame:
    """(id, run, sha, check, n_bytes) of every row, and its number in a numbered table; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.col(ROW).alias("row")] if ROW in df.columns else []
    return df.select(*row, F.col(id_col).alias("id"), spread(F.col(id_col), runs=runs).alias("run"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("n_bytes"))


def merge_tree(rows: DataFrame, keep: str = "smallest", runs: int = SPREAD, fan_in: int = 16) -> DataFrame:
    """One entry for each digest: (sha, check, n_bytes, keep_id, group_size), sorted by ranges of digests."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    level = rows.groupBy("run", *DIGEST).agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    last = None
    while runs > 1:
        runs = -(-runs // fan_in)
        below, last = last, _sorted_run(level)
        if below is not None:
            discard(below)
        level = _merged(last, F.floor(F.col("run") / fan_in).cast("int"), best)
    return level.drop("run")


def _sorted_run(level: DataFrame) -> DataFrame:
    """level written as sorted runs: each task's file holds neighbouring runs, or a range of one run's digests."""
    n = shuffle_partitions(level.sparkSession)
    return staged(level.repartitionByRange(n, "run", "sha").sortWithinPartitions("run", *DIGEST), "run")


def _merged(level: DataFrame, parent: Column, best: Callable[[Column], Column]) -> DataFrame:
    """The runs of one parent as one: a range exchange by (parent, digest) and a merge of what arrives, then entries of one
    digest, which are neighbours now, become one. The identifier is aggregated as a struct, which Spark does by a pass over
    sorted rows and not by a hash table; ranges never part a digest, so that pass needs no exchange of its own."""
    n = shuffle_partitions(level.sparkSession)
    dealt = level.withColumn("run", parent).repartitionByRange(n, "run", "sha").sortWithinPartitions("run", *DIGEST)
    out = dealt.groupBy("run", *DIGEST).agg(best(F.when(F.col("keep_id").isNotNull(), F.struct("keep_id"))).alias("best"), F.sum("group_size").alias("group_size"))
    return out.select("run", *DIGEST, F.col("best.keep_id").alias("keep_id"), "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = SPREAD, fan_in: int = 16) -> DataFrame:
    """For every row of df: id_col, keep_id, group_size, kept, text_sha256. Texts are equal when identical.

    Null texts count as empty, and empty texts are one group. Rows with a null id count in group_size; they are kept only
    if no row of the group has an id (then nothing tells them apart, and all are). Rows that repeat the id that stays are
    all marked kept; drop_copies() leaves one row of a group. An empty table gives an empty result. Other columns are not read.
    """
    # runs by row: rows without an id, or with one id, are spread as well
    rows = staged(digest_rows(df, id_col, text_col, runs).withColumn("run", spread(F.monotonically_increasing_id(), runs=runs)), "digests")
    out = attach(rows, merge_tree(rows, keep, runs, fan_in), DIGEST)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of each group of equal texts: of the rows with the id that exact_dedup() keeps (without any id in the group,
    of all its rows) one stays. Rows are told apart by a staged number, so an id may be null or name several texts."""
    rows = numbered(df)
    digests = staged(digest_rows(rows, id_col, text_col).withColumn("run", spread("row")), "digests")
    marked = attach(digests, merge_tree(digests, keep), DIGEST)
    stays = marked.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*DIGEST).agg(F.min("row").alias("row")).select("row")
    gone = staged(digests.select("row").join(stays, "row", "left_anti").withColumnRenamed("row", ROW), "copies")
    return without_ids(rows, gone, ROW).drop(ROW)
