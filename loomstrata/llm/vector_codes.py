"""Product codes of vectors: weighted Lloyd rounds over the distinct integer parts of each position.

Components become integers floor(4096 * x). A vector is cut into equal consecutive parts; each position has a codebook of a
few entries. Equal parts of a position are one row with a weight, so a round reads distinct parts only: tasks give each the
nearest entry and send exact sums by (position, entry), some thousand numbers, which Spark adds up before the driver sees
them. At the end the distinct parts get their codes and errors, and a join on (position, part) brings those to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, small_enough, spread, staged, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LONGEST = (1 << 63) - 1
#: Bytes a component takes in a packed part: the least of these that holds all of the part's components.
WIDTHS = (2, 4, 8, 24)
#: Sums are sent as high * LIMB + low, each within a decimal(38, 0).
LIMB = 10**18


def finite(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, v) of the rows whose vector is there and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    return df.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad)


def whole(vectors: pa.Array, dimension: int) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold it exactly; a row a vector, padded with zeros to dimension."""
    lengths = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    if (lengths == dimension).all():
        x = flat.reshape(len(lengths), dimension)
    else:
        x = np.zeros((len(lengths), dimension))
        x[np.arange(dimension) < lengths[:, None]] = flat
    return np.floor(x * SCALE)


def pack(x: np.ndarray) -> pa.Array:
    """Each row of integers (held as doubles) as little-endian bytes; equal rows have equal bytes."""
    top = np.where(x < 0, -x - 1, x).max(axis=1, initial=0)
    if (top < 1 << 15).all():
        ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(2 * x.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.astype("<i2").tobytes())])
    out = []
    for row, t in zip(x, top):
        w = next(w for w in WIDTHS if t < 2.0 ** (8 * w - 1))
        out.append(row.astype(f"<i{w}").tobytes() if w <= 8 else b"".join(int(c).to_bytes(w, "little", signed=True) for c in row))
    return pa.array(out, pa.binary())


def unpack(parts: pa.Array, length: int) -> np.ndarray:
    """The rows that pack() made: doubles if all are of the narrowest kind, else Python integers."""
    if length == 0:
        return np.zeros((len(parts), 0))
    ends = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset)
    if (np.diff(ends) == 2 * length).all():
        return np.frombuffer(parts.buffers()[2] or b"", "<i2", len(parts) * length, int(ends[0])).reshape(-1, length).astype(np.float64)
    out = np.empty((len(parts), length), object)
    for i, p in enumerate(parts.to_pylist()):
        w = len(p) // length
        out[i] = [int.from_bytes(p[k : k + w], "little", signed=True) for k in range(0, len(p), w)]
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest row of book (of equal ones the lower) for each row of x, and the squared distance."""
    top = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * max(1, x.shape[1]) * int(top) ** 2 < 1 << 53:  # every term and sum below is an exact double
        x, book = x.astype(np.float64), book.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at].astype(np.int64)
    x, book = exact(x), exact(book)
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    at = np.array([min(range(len(book)), key=lambda e: (row[e], e)) for row in d], dtype=np.int64)
    return at, np.array([row[a] for row, a in zip(d, at)], dtype=object)


def exact(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)


def _groups(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch, their parts)."""
    part, x = np.asarray(batch["part"]), unpack(batch["value"], length)
    for p in np.unique(part):
        where = np.flatnonzero(part == p)
        yield int(p), where, x[where]


def _parts(rows: DataFrame, dimension: int, keep: bool) -> DataFrame:
    """(part, value) of each vector's parts, a row each; keep: with the row's number, and its id and label at part 0."""
    length = dimension // PARTS
    if keep:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "part tinyint, value binary" + (f", row long, id {kinds['id']}, label {kinds['label']}" if keep else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b["v"], dimension)
            for p in range(PARTS):
                value = pack(x[:, p * length : (p + 1) * length])
                cols = {"part": pa.array(np.full(len(x), p, np.int8)), "value": value}
                if keep:
                    cols |= {"row": b["row"]} | {c: b[c] if p == 0 else pa.nulls(len(x), b[c].type) for c in ("id", "label")}
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(tidy(cut), schema)


def _sums(weighted: DataFrame, books: list[np.ndarray], length: int) -> list:
    """(part, entry, at, high, low): sums of the parts nearest to each entry, by component; at -1 has their number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            n = np.asarray(b["n"])
            for p, where, x in _groups(b, length):
                at, _ = nearest(x, books[p])
                weight = n[where].astype(object)
                x = x if x.dtype == object else x.astype(np.int64)
                small = x.dtype != object and int(np.abs(x).max(initial=0)) * int(n[where].sum()) < 1 << 62
                for e in np.unique(at):
                    mine = at == e
                    s = (x[mine] * n[where][mine, None]).sum(0) if small else (exact(x[mine]) * weight[mine, None]).sum(0)
                    t = total.setdefault((p, int(e)), [0] * (length + 1))
                    for j, c in enumerate([*s, weight[mine].sum()]):
                        t[j] += int(c)
        rows = [(p, e, j if j < length else -1, str(s // LIMB), str(s % LIMB)) for (p, e), t in total.items() for j, s in enumerate(t)]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 10_000])], ["part", "entry", "at", "high", "low"])

    sent = weighted.mapInArrow(tidy(each), "part long, entry long, at long, high string, low string")
    add = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return sent.groupBy("part", "entry", "at").agg(*add).collect()


def lloyd(weighted: DataFrame, books: list[np.ndarray], length: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after some rounds: every entry becomes floor(sum / count) of the parts nearest to it; unused ones stay."""
    for _ in range(rounds):
        got = {(r["part"], r["entry"], r["at"]): int(r["high"]) * LIMB + int(r["low"]) for r in _sums(weighted, books, length)}
        books = [b.copy() for b in books]
        for p, e, at in got:
            if at >= 0:
                books[p][e, at] = got[p, e, at] // got[p, e, -1]
    return books


def _coded(weighted: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """(part, value, entry, off) of every distinct part: its code and squared distance, LONGEST at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entry, off = np.zeros(b.num_rows, np.int16), np.zeros(b.num_rows, np.int64)
            for p, where, x in _groups(b, length):
                at, d = nearest(x, books[p])
                entry[where], off[where] = at, np.minimum(d, LONGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["part"], b["value"], pa.array(entry), pa.array(off)], ["part", "value", "entry", "off"])

    return weighted.mapInArrow(tidy(each), "part tinyint, value binary, entry smallint, off long")


def _long(total):
    """A decimal sum as a long, LONGEST at most."""
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id_col, code, error, label_error) of every kept row, and the codebooks: for each position, entries x components.

    Rows whose vector is null, or holds null or non-finite components, go. Codebooks start as the parts of the `entries`
    rows with the smallest ids (nulls last, ties by vector; fewer rows make smaller codebooks). Repeated rows all stay. Vectors
    shorter than the longest, or of a length that PARTS doesn't divide, count as padded with zeros; a vector without
    components is all padding. Components of any size are exact; an error beyond a long is the largest long. An empty table
    gives an empty result and codebooks without entries. Only the three columns are read.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    rows = finite(df, id_col, vector_col, label_col)
    first = rows.select("id", "v", F.size("v").alias("n")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    length = -(-longest // PARTS)
    begin = whole(pa.array([r["v"] for r in first], pa.list_(pa.float64())), length * PARTS)
    books = [exact(begin[:, p * length : (p + 1) * length]) for p in range(PARTS)]
    if not first:
        zero = F.lit(0).cast("long")
        none = rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), zero.alias("error"), zero.alias("label_error"))
        return none.limit(0), books
    weighted = staged(_parts(rows, length * PARTS, False).groupBy("part", "value").agg(F.count("*").alias("n")), "parts")
    books = lloyd(weighted, books, length, rounds)
    found = staged(_coded(weighted, books, length), "coded")
    back = _parts(rows, length * PARTS, True).join(found, ["part", "value"])
    codes = [F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(PARTS)]
    code = F.concat(*[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in codes]).alias("code")
    out = back.groupBy("row").agg(F.max("id").alias("id"), F.max("label").alias("label"), code, F.sum(F.col("off").cast("decimal(38,0)")).alias("error"))
    label = [F.col("label").isNull().alias("bare"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label")]
    out = staged(out.select("id", *label, "code", "error", spread("row").alias("run")), "codes")
    by_label = staged(out.groupBy("bare", "label").agg(F.sum("error").alias("label_error")), "label_errors")
    keys = ["bare", "label"]
    out = out.join(F.broadcast(by_label), keys) if small_enough(by_label) else attach(out, by_label, keys)
    return out.select(F.col("id").alias(id_col), "code", _long(F.col("error")).alias("error"), _long(F.col("label_error")).alias("label_error")), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all components by position, entry and component, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.reshape(-1)).encode()).hexdigest()


def reconstruct(codes: list[str], books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for, as doubles."""
    at = np.array([[int(c[2 * p : 2 * p + 2], 16) for p in range(PARTS)] for c in codes], dtype=np.int64).reshape(len(codes), PARTS)
    return np.concatenate([books[p][at[:, p]].astype(np.float64) for p in range(PARTS)], axis=1) / SCALE


def digest(df: DataFrame) -> DataFrame:
    """compress() with a hash of the codebooks beside every row."""
    out, books = compress(df)
    return out.withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))
