"""Tables that a later step reads again, written as Parquet to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where that is unset, a temporary folder if all of Spark runs in one
    process of one machine (tests, benches); on a cluster it has to be set."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomstrata-")
    return _local[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the file system deletes it when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/loomstrata-{uuid.uuid4().hex}/{name}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path.getParent())
    if (inside := _scope.get()) is not None:
        inside.append((spark, path))
    return path


@contextmanager
def scoped() -> Iterator[None]:
    """Deletes at its end what operators wrote within, on this thread: for services that live on. Results have to be
    collected or written within, since they may read those tables; scopes can be nested."""
    inside: list[tuple[SparkSession, str]] = []
    token = _scope.set(inside)
    try:
        yield
    finally:
        _scope.reset(token)
        for spark, path in inside:
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and what made it runs once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def path_of(written_table: DataFrame) -> str:
    return _paths[written_table]


def discard(*written_tables: DataFrame) -> None:
    """Deletes tables that written() gave. Nothing that is still to be run may read them."""
    for t in written_tables:
        delete(t.sparkSession, _paths.pop(t))


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
