"""Shared plumbing: staging in the cluster's shared folder, skew-safe attachment of per-key results, id filters."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.staging import delete, discard, path_of, scratch_path, written  # noqa: F401  (some for other modules)

#: A side is broadcast by hint only when it was counted and has at most this many 8-byte ids (4 MB).
BROADCAST_IDS = 500_000
#: Rows and bytes of an Arrow batch while a table is staged: what a Python worker holds of long texts at once.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
_record: list[str] | None = None
#: Rows of one key are spread over this many runs before they are joined with what was found for the key.
SPREAD = 256

@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """ARROW_BATCH for the plans that are run within."""
    old = {k: spark.conf.get(k) for k in ARROW_BATCH}
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def tuned(spark: SparkSession) -> SparkSession:
    """The session with ARROW_BATCH set for good, for plans that are run after a query has returned them."""
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)
    return spark


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and every executor can read it again."""
    with small_batches(df.sparkSession):
        out = written(df, name)
    if _record is not None:
        _record.append(path_of(out))
    return out


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Notes in paths what is staged within."""
    global _record
    old, _record = _record, paths
    try:
        yield
    finally:
        _record = old


#: The column of numbered().
ROW = "_loomstrata_row"


def numbered(df: DataFrame) -> DataFrame:
    """df, staged with a number of each row in ROW, so that rows that share an id, or have none, can be told apart."""
    return staged(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def shielded(rows: DataFrame) -> DataFrame:
    """rows with the flag no_id and an id that is never null: pandas would turn integers beside nulls to doubles, which
    lose ids above 2**53."""
    kind = rows.schema["id"].dataType
    filled = F.coalesce("id", F.lit(0).cast(kind)) if isinstance(kind, NumericType) else F.col("id")
    return rows.withColumn("no_id", F.col("id").isNull()).withColumn("id", filled)


def restored(rows: DataFrame, id_col: str) -> DataFrame:
    """What a function made of shielded() rows, with its nulls back."""
    return rows.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), *[c for c in rows.columns if c not in ("id", "no_id")])


def tidy(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """each, a function of a task's batches, which at its end gives freed memory back to the system: a worker process
    lives on into other stages, and without this keeps the most that any of them took."""

    def run(batches: Iterator) -> Iterator:
        yield from each(batches)
        give_back()

    return run


def give_back() -> None:
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(*cols: Column | str, runs: int = SPREAD) -> Column:
    """A run number that depends only on the row, so a key with many rows lies in many runs."""
    return F.pmod(F.xxhash64(*cols), F.lit(runs)).cast("int")


def attach(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "left", run: str = "run") -> DataFrame:
    """rows joined with found (one row a key) on keys. rows has a run number: a key's result first goes to the distinct
    (run, key), at most one row a run, and from there to the rows, so that no join key holds all rows of a hot key."""
    heads = rows.select(run, *keys).distinct().join(found, keys)
    return rows.join(heads, [run, *keys], how)


def small_enough(ids: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Whether ids, a staged table, has at most limit rows."""
    return ids.limit(limit + 1).count() <= limit


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is not in the staged ids. Broadcasts ids after counting them, else joins by shuffle.
    Rows with a null id stay."""
    right = ids.select(F.col(id_col).alias("_gone")).distinct()
    if small_enough(right):
        right = F.broadcast(right)
    return docs.join(right, docs[id_col] == F.col("_gone"), "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is in the staged ids, by the same rule."""
    right = ids.select(F.col(id_col).alias("_kept")).distinct()
    if small_enough(right):
        right = F.broadcast(right)
    return docs.join(right, docs[id_col] == F.col("_kept"), "left_semi")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver, in a tuned session."""
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")
