"""What operators write is gone at the end of a scope, and not before."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from loomstrata.operators import statistics
from loomstrata.sources import staging


def folders(spark) -> set[str]:
    root = staging.scratch_root(spark).removeprefix("file://")
    return {f for f in os.listdir(root) if f.startswith("loomstrata-")}


def test_scopes(spark):
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(50)], "g string, v double")
    outside = staging.written(rows, "outside")
    before = folders(spark)
    with staging.scoped():
        n = statistics.mann_whitney(rows, "v", F.col("v") < 3, ["g"]).count()
        within = folders(spark) - before
        with staging.scoped():
            staging.written(rows, "inner")
            assert len(folders(spark) - before) == len(within) + 1
        assert folders(spark) - before == within
    assert n == 1 and within and folders(spark) == before and outside.count() == 50
    kept = staging.written(rows, "kept")
    with staging.scoped():
        staging.discard(staging.written(rows, "discarded"))
    assert kept.count() == 50
