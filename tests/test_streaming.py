"""Results that arrive as files: keys in a state store, restarts after failures, batches that don't read results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomstrata.streaming import runs

SCHEMA = "k string, v long"


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def stream(spark, tmp_path):
    return runs.read_runs(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_a_batch=1)


def go(spark, tmp_path, score=lambda d: d.withColumn("s", F.col("v") * 2), checkpoint="ck"):
    runs.append_scored(stream(spark, tmp_path), score, str(tmp_path / "out"), str(tmp_path / checkpoint), ["k"]).awaitTermination()
    return sorted(((r.k, r.s) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)


def test_keys_are_kept_over_batches_and_restarts(spark, tmp_path):
    put(spark, tmp_path, [("a", 1), ("b", 2), (None, 3)])
    put(spark, tmp_path, [("a", 9), ("c", 4)])
    assert go(spark, tmp_path) == [("a", 2), ("b", 4), ("c", 8), (None, 6)]
    put(spark, tmp_path, [("b", 9), ("d", 5), (None, 9)])
    assert go(spark, tmp_path) == [("a", 2), ("b", 4), ("c", 8), ("d", 10), (None, 6)]


def test_failed_batch_runs_again(spark, tmp_path):
    """The second batch fails after the first is committed; on restart its keys are still new, and results are once there."""
    put(spark, tmp_path, [("a", 1)])
    put(spark, tmp_path, [("b", 2), ("a", 7)])
    fail = lambda d: d.withColumn("s", F.when(F.col("k") == "b", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v") * 2))
    with pytest.raises(Exception, match="lost"):
        go(spark, tmp_path, fail)
    assert go(spark, tmp_path) == [("a", 2), ("b", 4)]


def test_results_of_another_checkpoint(spark, tmp_path):
    put(spark, tmp_path, [("a", 1), ("b", 2)])
    assert go(spark, tmp_path) == [("a", 2), ("b", 4)]
    put(spark, tmp_path, [("c", 3), ("a", 8)])
    assert go(spark, tmp_path, checkpoint="other") == [("a", 2), ("b", 4), ("c", 6)]


def test_batches_read_their_own_rows_only(spark, tmp_path):
    """Rows that a batch takes in don't grow with the batches before it, and its plan reads no results."""
    plans = []
    for i in range(6):
        put(spark, tmp_path, [(f"k{i}_{j}", j) for j in range(20)])

    def score(d):
        plans.append(d._jdf.queryExecution().optimizedPlan().toString())
        return d.withColumn("s", F.col("v"))

    query = runs.append_scored(stream(spark, tmp_path), score, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"])
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [20] * 6
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [20] * 6
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 120
    assert all("rocksdb" in str(p["stateOperators"][0]["customMetrics"]).lower() for p in progress)
    assert not any(str(tmp_path / "out") in p for p in plans)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
