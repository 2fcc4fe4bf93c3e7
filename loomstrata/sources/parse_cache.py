"""Parsed repositories kept by the content of their files: what hasn't changed since it was parsed is not lexed again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repository, snapshots
from .staging import discard, written

#: Goes into every digest. To be raised whenever the parsers give something else for the same files.
PARSER = "1"


def digests(files: DataFrame, framework: str) -> DataFrame:
    """(repo_name, digest): of the parser, the framework, and paths and contents of a repository's files. Contents are
    hashed where they are read; a repository's group holds a hash a file."""
    each = files.select("repo_name", F.sha2(F.concat_ws("\0", "path", F.sha2("content", 256)), 256).alias("sha"))
    listed = F.array_join(F.array_sort(F.collect_list("sha")), ",")
    return each.groupBy("repo_name").agg(F.sha2(F.concat_ws("|", F.lit(PARSER), F.lit(framework), listed), 256).alias("digest"))


def parsed_graph(
    files: DataFrame,
    framework: str,
    path: str,
    tries: int = 3,
    wait: float = 10.0,
    parse: Callable[[DataFrame, str], dict[str, DataFrame]] = repository.parse,
) -> dict[str, DataFrame]:
    """The graph at path after all repositories of files are in it as they are now, read back as one snapshot.

    Repositories whose digest the snapshot has are left as they are; the others are parsed and replaced in one write. What
    fails leaves the snapshot as it was, so it isn't cached, and is tried again after a growing wait; the last failure is
    raised. Repositories that files doesn't have stay."""
    spark = files.sparkSession
    for attempt in range(1, tries + 1):
        try:
            known = snapshots.read_graph(spark, path).get("repositories")
            now = written(digests(files, framework), "digests")
            changed = now if known is None else written(now.join(known.select("repo_name", "digest"), ["repo_name", "digest"], "left_anti"), "changed")
            if not changed.isEmpty():
                tables = parse(files.join(changed.select("repo_name"), "repo_name", "left_semi"), framework)
                snapshots.write_graph(tables | {"repositories": tables["repositories"].join(changed, "repo_name")}, path)
            discard(now)
            return snapshots.read_graph(spark, path)
        except Exception:
            if attempt == tries:
                raise
            time.sleep(wait * attempt)
    raise ValueError("tries is at least 1")
