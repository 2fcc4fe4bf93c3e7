"""Result rows that arrive as files: each key is kept once, results are appended, and a restart goes on where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.staging import written


def read_runs(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once_a_key(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it, so state stays bounded."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, time: str, width: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts, sums and means by window and group; rows later than the watermark don't count."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


#: Keys are kept in RocksDB, which holds what it can't keep in memory on disk, and writes a batch's changes only.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def append_scored(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Scores the first row of each key and appends it, by micro-batches; later rows of a key are passed over.

    Keys that were seen are the query's state, so a batch costs what its own rows do, however many results there are: no
    batch reads results. State and batch number are committed together, after the batch's results are written to a folder
    of that number; a batch that runs again after a failure meets the state from before it and replaces its own folder.
    Results that another checkpoint left under path count as done, too: their keys are read once, when a query starts, and
    rows are joined with that fixed set. Null keys are equal. What score() leaves out isn't asked again.
    """
    spark = rows.sparkSession
    own = f"run={hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    others = [f.getPath().toString() for f in fs.listStatus(where)] if fs.exists(where) else []
    others = [o for o in others if o.rpartition("/")[2].startswith("run=") and not o.endswith(own)]
    done = written(spark.read.option("basePath", path).parquet(*others).select(*keys).distinct(), "done") if others else None

    def batch(part: DataFrame, k: int) -> None:
        score(part if done is None else _without(part, done, keys)).write.mode("overwrite").parquet(f"{path}/{own}/batch={k}")

    before = {c: spark.conf.get(c, None) for c in STATE}
    for c, v in STATE.items():
        spark.conf.set(c, v)
    try:  # a query takes the session's settings when it starts
        return rows.dropDuplicates(keys).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def _without(part: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    names = {c: f"_of{i}" for i, c in enumerate(keys)}
    same = F.lit(True)
    for c, to in names.items():
        same &= F.col(c).eqNullSafe(F.col(to))
    return part.join(done.withColumnsRenamed(names), same, "left_anti")
