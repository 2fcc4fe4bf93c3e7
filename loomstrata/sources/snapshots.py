"""The property graph on disk as snapshots: writers replace whole repositories, readers see all of a write or none of it.

    <path>/<table>/version=<v>/   rows that a write brought
    <path>/_manifests/<name>/     (scope, version): where each repository's rows are
    <path>/_log/<number>.json     the manifest of a snapshot and the tables of each version in it

A write puts its tables and a new manifest in folders of their own. Nothing reads those until its log entry is there, one
small file that is renamed into place and never replaced. The snapshot is the entry with the highest number. If another
writer takes that number first, the manifest is made again on top of that one's; so writers of different repositories don't
undo each other, and of the same repository the last one stays.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import written

LOG, MANIFESTS, TRIES = "_log", "_manifests", 20


@dataclass
class Snapshot:
    """number: of the log entry; -1 before the first write. versions: the tables that each live version has."""

    number: int
    manifest: str | None
    versions: dict[str, list[str]]


class _Folder:
    """Files under a path, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root, self.jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        there = self.at(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(there)) if self.fs.exists(there) else []

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def put_new(self, name: str, text: str) -> bool:
        """Whether the file is there now with this text; False if there was one of that name before."""
        draft = self.at(f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.fs.makeQualified(self.at(name))
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self.fs.makeQualified(draft), target, no_overwrite)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def current(spark: SparkSession, path: str) -> Snapshot:
    return _current(_Folder(spark, path))


def _current(folder: _Folder) -> Snapshot:
    numbers = [n for n in folder.names(LOG) if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return Snapshot(-1, None, {})
    entry = json.loads(folder.text(f"{LOG}/{numbers[-1]}"))
    return Snapshot(int(numbers[-1].removesuffix(".json")), entry["manifest"], entry["versions"])


def write_graph(tables: dict[str, DataFrame], path: str, scope: str = "repo_name") -> int:
    """Replaces every repository that has a row in any of tables by what they hold; returns the snapshot's number.

    A repository is replaced as a whole: what it had in tables that have no row of it now, or aren't given, is gone. Other
    repositories stay. Rows without a repository are refused. Each table is written once, in the partitions it has."""
    spark = next(iter(tables.values())).sparkSession
    folder, version = _Folder(spark, path), f"v{uuid.uuid4().hex}"
    for name, table in tables.items():
        known = F.when(F.col(scope).isNull(), F.raise_error(F.lit(f"{name}: a row without {scope}"))).otherwise(F.col(scope))
        table.withColumn(scope, known).sortWithinPartitions(scope).write.parquet(f"{folder.root}/{name}/version={version}")
    parts = [spark.read.parquet(f"{folder.root}/{name}/version={version}").select(scope).distinct() for name in tables]
    fresh = written(reduce(DataFrame.unionByName, parts).distinct(), "replaced")
    for attempt in range(TRIES):
        before = _current(folder)
        rows = fresh.withColumn("version", F.lit(version))
        if before.manifest is not None:
            old = spark.read.parquet(f"{folder.root}/{MANIFESTS}/{before.manifest}")
            rows = rows.unionByName(old.join(fresh, scope, "left_anti"))
        manifest = f"{version}-{attempt}"
        rows.write.parquet(f"{folder.root}/{MANIFESTS}/{manifest}")
        live = {r["version"] for r in spark.read.parquet(f"{folder.root}/{MANIFESTS}/{manifest}").select("version").distinct().collect()}
        versions = {v: names for v, names in (before.versions | {version: sorted(tables)}).items() if v in live}
        if folder.put_new(f"{LOG}/{before.number + 1:012d}.json", json.dumps({"manifest": manifest, "versions": versions})):
            return before.number + 1
        folder.drop(f"{MANIFESTS}/{manifest}")
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")


def read_graph(spark: SparkSession, path: str, scope: str = "repo_name") -> dict[str, DataFrame]:
    """The tables of the snapshot as it is now, all of the same one, also where writes follow while they are read."""
    folder = _Folder(spark, path)
    now = _current(folder)
    if now.manifest is None:
        return {}
    manifest = spark.read.parquet(f"{folder.root}/{MANIFESTS}/{now.manifest}")
    out = {}
    for name in sorted({n for names in now.versions.values() for n in names}):
        there = [f"{folder.root}/{name}/version={v}" for v, names in now.versions.items() if name in names]
        # versions may have other columns than the ones before; finding that out reads all their footers
        rows = spark.read.option("basePath", f"{folder.root}/{name}").option("mergeSchema", len(there) > 1).parquet(*there)
        out[name] = rows.join(manifest, [scope, "version"], "left_semi").drop("version")
    return out


def compact(spark: SparkSession, path: str, scope: str = "repo_name") -> int:
    """The snapshot written again as one version, so reading opens one folder a table."""
    return write_graph(read_graph(spark, path, scope), path, scope)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes versions, manifests and log entries that the snapshot doesn't need, failed writes' among them, and names
    them. Not for while writers are at work or readers still read older snapshots."""
    folder = _Folder(spark, path)
    now = _current(folder)
    gone = [f"{MANIFESTS}/{m}" for m in folder.names(MANIFESTS) if m != now.manifest]
    gone += [f"{LOG}/{n}" for n in folder.names(LOG) if n != f"{now.number:012d}.json"]
    for table in folder.names(""):
        if table not in (LOG, MANIFESTS):
            gone += [f"{table}/{v}" for v in folder.names(table) if table not in now.versions.get(v.removeprefix("version="), [])]
    for name in gone:
        folder.drop(name)
    return gone
