"""Token files: independent zstandard frames, a trailing seek table in the public seekable format, a checksum a frame.

A file is: frames of whole documents' ids (little-endian, width bytes each; each frame also carries zstandard's content
checksum) | a skippable frame with the document index | the seek table, itself a skippable frame, at the very end. Any
zstandard decoder gets all ids from it; a reader of one document reads the two tables and one frame.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, shielded, shuffle_partitions, tidy
from .tokens import encoder, release

#: Fixed values of the format.
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, bytes.fromhex("b1ea928f")
HEADER = struct.Struct("<QBQ")  # ordinal, width, documents
FRAME_BYTES = 1 << 20
#: Text bytes a file is made of, about; a file's ids, compressed, are what a task holds.
FILE_BYTES = 64 << 20
#: Pieces in a worker's tokenizer table; this stage holds little else, so they may be many.
PIECES = 1_100_000


class Writer:
    """Collects documents in order and gives a file's bytes. ordinal: the file's place among all files."""

    def __init__(self, ordinal: int, width: int = 2, level: int = 3) -> None:
        self.ordinal, self.width, self.open, self.frames, self.seek, self.docs = ordinal, width, [], [], [], []
        self.size, self.zstd = 0, zstandard.ZstdCompressor(level=level, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, len(ids) // self.width))
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.open)
        self.frames.append(self.zstd.compress(raw))
        self.seek.append((len(self.frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def done(self) -> bytes:
        if self.size:
            self._frame()
        doc_id, null, n = (np.array(x) for x in zip(*self.docs)) if self.docs else (np.zeros(0),) * 3
        index = self.zstd.compress(HEADER.pack(self.ordinal, self.width, len(self.docs)) + doc_id.astype("<i8").tobytes() + null.astype("<u1").tobytes() + n.astype("<u8").tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IB", len(self.seek), 0x80) + SEEKABLE
        return b"".join([*self.frames, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", SEEK_MAGIC, len(table)), table])


class Reader:
    """read(offset, length) gives bytes of a file of size bytes. Only the tables are read at first; a document costs the
    frame (or frames) that it lies in, whose checksums are verified."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        foot = read(size - 9, 9)
        if foot[5:] != SEEKABLE or foot[4] != 0x80:
            raise ValueError("no seek table at the end")
        count = struct.unpack("<I", foot[:4])[0]
        begin = size - 9 - 12 * count - 8
        self.read, self.zstd = read, zstandard.ZstdDecompressor()
        table = np.frombuffer(read(begin + 8, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.at, self.raw_at, self.sums = np.concatenate([[0], np.cumsum(table[:, 0])]), np.concatenate([[0], np.cumsum(table[:, 1])]), table[:, 2]
        index = self.zstd.decompress(read(int(self.at[-1]) + 8, begin - int(self.at[-1]) - 8))
        self.ordinal, self.width, n = HEADER.unpack_from(index)
        at = HEADER.size
        self.doc_id, self.null, self.n_tokens = np.frombuffer(index, "<i8", n, at), np.frombuffer(index, "<u1", n, at + 8 * n), np.frombuffer(index, "<u8", n, at + 9 * n).astype(np.int64)
        self.start = np.cumsum(self.n_tokens) - self.n_tokens

    @classmethod
    def of(cls, content: bytes) -> Reader:
        return cls(lambda at, n: content[at : at + n], len(content))

    def frame(self, k: int) -> bytes:
        raw = self.zstd.decompress(self.read(int(self.at[k]), int(self.at[k + 1] - self.at[k])), max_output_size=int(self.raw_at[k + 1] - self.raw_at[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return raw

    def ids(self, position: int) -> np.ndarray:
        """Ids of the document at a position of the file."""
        a = int(self.start[position]) * self.width
        b = a + int(self.n_tokens[position]) * self.width
        if a == b:
            return np.zeros(0, f"<u{self.width}")
        first, last = (int(np.searchsorted(self.raw_at, x, "right")) - 1 for x in (a, b - 1))
        raw = b"".join(self.frame(k) for k in range(first, last + 1))
        return np.frombuffer(raw[a - int(self.raw_at[first]) : b - int(self.raw_at[first])], f"<u{self.width}")

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id; None: it isn't in the file."""
        where = np.flatnonzero((self.doc_id == doc_id) & (self.null == 0))
        return self.ids(int(where[0])) if len(where) else None

    def every(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the file, ids) of all documents; each frame is decompressed once."""
        k, raw = -1, b""
        for p in range(len(self.doc_id)):
            a, n = int(self.start[p]) * self.width, int(self.n_tokens[p])
            while n and (k < 0 or a >= self.raw_at[k + 1]):
                k += 1
                raw = self.frame(k)
            ids = np.frombuffer(raw, f"<u{self.width}", n, a - int(self.raw_at[k])) if n else np.zeros(0, f"<u{self.width}")
            yield None if self.null[p] else int(self.doc_id[p]), int(self.start[p]), ids


def write_tokens(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every whole text of df, each followed by end_id, to token files under path, in ascending order of
    id over all files (null ids first; rows with one id by the text's hash). Null and empty texts are the end id alone.
    An empty table gives no file. Other columns are not read.

    Rows are range-sorted by id; each task makes one file. Files go through Spark's text sink with the format's last four
    bytes as line end, so they are committed once a task and work on any file system that Spark writes to.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-total // file_bytes))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    dealt = shielded(dealt)
    end = end_id.to_bytes(2, "little")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out, code = Writer(TaskContext.get().partitionId()), encoder(tokenizer, PIECES)
        for b in batches:
            for doc_id, no_id, ids in zip(b["id"].tolist(), b["no_id"].tolist(), code.encode(b["text"])):
                out.add(None if no_id else doc_id, ids + end)
        if out.docs:
            yield pd.DataFrame({"content": [out.done()[: -len(SEEKABLE)]]})

    dealt.mapInPandas(tidy(files), "content binary").select(F.col("content").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", SEEKABLE.decode("latin-1")).text(path)


def read_tokens(spark, path: str, summarise: Callable[[int, Iterable[tuple[int | None, int, np.ndarray]]], pd.DataFrame], schema: str) -> DataFrame:
    """summarise(ordinal, documents) for each token file under path; documents are (id, start in the file, ids)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            for content in b["content"]:
                if len(content):
                    r = Reader.of(content)
                    yield summarise(r.ordinal, r.every())

    return files.mapInPandas(tidy(each), schema)


def _opened(uri: str) -> Reader:
    """A reader of one token file, by ranges: the two tables now, frames as they are asked for."""
    fs, path = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    file = fs.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return Reader(read, file.size())


def read_documents(spark, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids) of the documents under path whose id is in wanted, a row for each document of the id: the document
    indexes of all files are joined with the ids, then each file that has some is opened by ranges and only the frames that
    they lie in are read and decompressed. Null ids are no one's; ids that no file has give no row."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["path"]:
                r = _opened(uri)
                at = np.flatnonzero(r.null == 0)
                yield pd.DataFrame({"path": uri, "at": at.astype(np.int64), "id": r.doc_id[at]})

    def fetch(part: pd.DataFrame) -> pd.DataFrame:
        r, part = _opened(part["path"].iloc[0]), part.sort_values("at")
        return pd.DataFrame({"id": part["id"], "ids": [r.ids(int(k)).astype(np.int32) for k in part["at"]]})

    listed = files.mapInPandas(tidy(index), "path string, at long, id long")
    ids = wanted.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    found = listed.join(ids, "id", "left_semi").groupBy("path").applyInPandas(fetch, "id long, ids array<int>")
    return found.withColumnRenamed("id", id_col)


def _digest(ordinal: int, documents: Iterable[tuple[int | None, int, np.ndarray]]) -> pd.DataFrame:
    rows = [(ordinal, d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in documents]
    out = pd.DataFrame(rows, columns=["part", "doc_id", "at", "n_tokens", "ids_crc32"])
    return out.assign(doc_id=pd.array([r[1] for r in rows], dtype="Int64"))


def token_digest(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes token files in the shared folder, reads them back and gives, for each document: id_col, start, n_tokens,
    ids_crc32. See write_tokens() for nulls, ties and empty tables."""
    from pyspark.sql import Window

    from .common import staged

    spark = df.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(df, path, tokenizer, id_col, text_col, end_id)
    docs = staged(read_tokens(spark, path, _digest, "part long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token_digest")
    files = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = files.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    return docs.join(before, "part").select(F.col("doc_id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
