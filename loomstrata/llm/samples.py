"""Bounded samples of labelled rows, the only rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the texts of a sample, at most.
SAMPLE_BYTES = 64 << 20


def by_label(labels: DataFrame, label: str, usable: Column, values: list, each: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label): of the rows with each of the values, where usable holds, the `each` with the lowest hash of the id."""
    rows = labels.filter(usable & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    parts = [rows.filter(F.col("label") == v).orderBy(F.xxhash64(id_col), id_col).limit(each) for v in values]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col(id_col).alias("id"), "label")


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, object]]:
    """(text, label) of the documents in chosen, a sample of a stated size, in the order of their ids. Empty texts go; of an
    id with several rows the text with the lowest hash counts, once. Of a sample beyond most_bytes those texts go that come
    last by the hash of id and text. The driver gets a number for each chosen id, and then the texts that stay."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("length(text) > 0")
    rows = rows.join(F.broadcast(chosen), "id").withColumn("at", F.xxhash64("id", "text"))
    firsts = rows.groupBy("id").agg(F.min(F.struct("at", F.octet_length("text").alias("size"))).alias("x")).collect()
    stay, room = [], most_bytes
    for r in sorted(firsts, key=lambda r: (r["x"]["at"], r["id"])):
        room -= r["x"]["size"]
        if room < 0:
            break
        stay.append((r["id"], r["x"]["at"]))
    if not stay:
        return []
    kept = docs.sparkSession.createDataFrame(stay, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("at", T.LongType())]))
    got = rows.join(F.broadcast(kept), ["id", "at"]).groupBy("id").agg(F.any_value("text").alias("text"), F.max("label").alias("label")).collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: r["id"])]


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(by))
