"""A training corpus from the documents table: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstrata.llm import decontaminate, exact_dedup, jaccard_join, packing, tokens, toxicity
from loomstrata.llm.common import ROW, delete, discard, numbered, read, recorded, staged, tuned, without_ids

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labelled ones, gives less than 0.3. Null and empty texts have no
    clauses, and their score is that of a text without any; repeated rows are decided alike. Without labels, or without
    documents that have them, nothing is toxic."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scores(model, F.col("text"), spark) < 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the smallest id. Null texts count as empty, and empty texts are one group."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by Jaccard similarity 0.75 or more of five-word shingles, the one with the smallest id.
    Stages decide by row: an id may be null or repeated. Null and empty texts, and those without words, all stay."""
    rows = numbered(docs)
    found = jaccard_join.jaccard_components(rows, id_col=ROW, k=5, t=Fraction(3, 4)).join(rows.select(ROW, "doc_id"), ROW)
    stays = found.groupBy("component_id").agg(F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias(ROW)).select(ROW)
    gone = rows.select(ROW).join(stays, ROW, "left_anti")
    return without_ids(rows, staged(gone, "near_copies"), ROW).drop(ROW)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts have none; with no items, or none with words,
    all documents stay."""
    rows = numbered(docs)
    found = decontaminate.find_passages(rows, read(spark, sf_dir, "benchmark"), id_col=ROW)
    return without_ids(rows, staged(found.select(ROW), "leaks"), ROW).drop(ROW)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences along the Hilbert curve. A null or empty text is its end id alone; no documents make no
    pieces."""
    tuned(spark)
    return packing.digest(packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), end_id=1))


#: What the last stage staged. It goes when the next stage begins: by then its result is written, as STAGES asks for.
_left: list[str] = []


def _next(stage: Stage) -> Stage:
    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            delete(spark, _left.pop())
        with recorded(_left):
            return stage(spark, docs, sf_dir)

    return call


#: Each is called with what the one before returned, written as Parquet and read again.
_IN_ORDER = {
    "toxicity": drop_toxic,
    "exact_dedup": drop_copies,
    "jaccard_join": drop_near_copies,
    "decontaminate": drop_leaks,
    "packing": pack_documents,
}
STAGES = [(name, _next(stage)) for name, stage in _IN_ORDER.items()]

#: A learned stage and tokenizers can't be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, in order, over all documents."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
