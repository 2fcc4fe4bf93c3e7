"""Packing along a space-filling curve: hashed document vectors are projected to few dimensions, documents are
range-sorted by their Hilbert key, and neighbours along the curve fill sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shielded, shuffle_partitions, staged, tidy
from .tokens import encoder, release

#: Places of a hashed document vector, dimensions of the curve and bits of each.
PLACES, DIMENSIONS, BITS = 256, 3, 16
#: Bytes of ids that a task packs, about.
TASK_BYTES = 64 << 20
#: Pieces in a worker's tokenizer table.
PIECES = 550_000


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each point's distance along the Hilbert curve; points: unsigned integers under 2**bits, a row a point.
    Skilling's transform (2004): undo excess work from the highest bit down, Gray-encode, then interleave the bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """From token ids to a key: signed hashing to PLACES, unit length, a fixed random projection, a squashed grid."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.place = rng.integers(0, PLACES, 1 << 16)
        self.sign = rng.choice([-1.0, 1.0], 1 << 16)
        self.to = rng.normal(size=(PLACES, DIMENSIONS))

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        v = np.stack([np.bincount(self.place[d], self.sign[d], PLACES) for d in documents]) if documents else np.zeros((0, PLACES))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        unit = 1 / (1 + np.exp(-1.702 * (v @ self.to)))
        return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _pieces(part: int, batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Cuts a task's run of documents every length ids. What is left at the end is cut by the binary digits of its length,
    so its sequences have a power of two and are not padded."""
    first, used, held, k = part << 32, 0, [], 0
    for b in batches:
        out = []
        for doc, no_id, raw in zip(b["id"].tolist(), b["no_id"].tolist(), b["ids"]):
            doc = None if no_id else doc
            n, at = len(raw) // 2, 0
            while at < n:
                m = min(n - at, length - used)
                held.append((doc, at, m, raw[2 * at : 2 * (at + m)], n))
                at, used = at + m, used + m
                if used == length:
                    out += _laid(held, first + k)
                    held, used, k = [], 0, k + 1
        if out:
            yield _wide(out)
    out = []
    for size in (1 << s for s in range(length.bit_length(), -1, -1)):
        if used & size:
            mine, room = [], size
            while room:
                doc, at, m, raw, n = held.pop(0)
                if m > room:
                    held.insert(0, (doc, at + room, m - room, raw[2 * room :], n))
                    m, raw = room, raw[: 2 * room]
                mine.append((doc, at, m, raw, n))
                room -= m
            out += _laid(mine, first + k)
            k += 1
    if out:
        yield _wide(out)


def _laid(held: list[tuple], sequence: int) -> list[tuple]:
    out, offset = [], 0
    for doc, at, m, raw, n in held:
        out.append((doc, at, m, raw, n, sequence, offset))
        offset += m
    return out


def _wide(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in out["ids"]]
    return out.assign(id=pd.array([r[0] for r in rows], dtype="Int64"), ids=ids)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pieces of the sequences: id_col, start (the document's ids before the piece), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset (in the sequence, gapless from 0). length is a power of two.

    Every document is its whole text's ids and end_id; null and empty texts are end_id alone. Each id is in one piece.
    Sequences have length ids; each task's last ones have powers of two, so nothing is padded. Documents of equal key
    (copies) lie by id, so they are spread like others; rows that repeat an id are packed each. Null ids stay null.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = end_id.to_bytes(2, "little")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, curve = encoder(tokenizer, PIECES), Curve()
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                ids = [x + end for x in code.encode(part["text"])]
                yield pd.DataFrame({"id": part["id"], "no_id": part["no_id"], "curve": curve.keys([np.frombuffer(x, "<u2") for x in ids]), "ids": ids})

    coded = staged(shielded(rows).mapInPandas(tidy(encode), "id long, no_id boolean, curve long, ids binary"), "coded")
    total = coded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-total // TASK_BYTES))
    dealt = coded.withColumn("tie", F.xxhash64("ids")).repartitionByRange(n, "curve", "tie", "id").sortWithinPartitions("curve", "tie", "id").select("id", "no_id", "ids")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        release()
        return _pieces(TaskContext.get().partitionId(), batches, length)

    out = dealt.mapInPandas(tidy(fill), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pack()'s rows with ids as their checksum."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
