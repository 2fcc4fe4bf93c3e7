"""WARC archives as a PySpark data source, and pages as archives whose equal payloads are stored once.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").load(path).filter("record_type = 'revisit'")

Writing: each task makes archives of its own, a gzip member a record, with the member's length in the `sl` extra field. A
commit is one small file, put by rename, which lists the archives of the tasks that succeeded and places at which they can
be split; what failed or repeated tasks left is never listed. Reading: partitions are ranges of archives, planned from those
lists (or, without any, whole `.warc` and `.warc.gz` files). Predicates on the record type and other header columns go down
to the scan, which inflates a record's headers first and seeks over the rest of an unwanted record. The payload is inflated
only if the schema that is asked for has it: `.schema("record_type string, target_uri string")` reads headers alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull
from pyspark.sql.datasource import LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .common import attach, give_back, scratch_path, small_enough, spread, staged, tuned

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes long, headers map<string,string>, payload binary"
)
#: Fixed values of the format: the header of each column, and the profile of records whose payload is another's.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, END = b"\x1f\x8b\x08", b"\r\n\r\n"
SKIP = struct.Struct("<2sHII")  # the gzip subfield `sl`: length of the member, and of what is in it
#: An archive is closed beyond this many bytes; within it, a place for a split is noted at each SPLIT_BYTES.
FILE_BYTES, SPLIT_BYTES, PARTITION_BYTES = 1 << 30, 8 << 20, 128 << 20
#: Bytes that are read and inflated at a time until a record's headers are there, and bytes and rows of a batch.
WINDOW, HEAD, BATCH_BYTES, BATCH_ROWS = 256 << 10, 2 << 10, 2 << 20, 1000
COMMITS = "_commits"


# --- one record ---------------------------------------------------------------------------------------------------------


def _line(text: str) -> str:
    """text as a header's value: controls and spaces at the ends would end it, so they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text.replace(" ", "%20"))


def record(row: dict, date: str) -> bytes:
    """A record's bytes. row has the columns of SCHEMA (headers aside); a revisit has no payload but its length."""
    payload, revisit = row.get("payload") or b"", row.get("record_type") == "revisit"
    n = row.get("payload_bytes") if revisit and row.get("payload_bytes") is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row.get(column) or {"record_type": "response", "date": date}.get(column)
        if value is not None:
            head.append(f"{name}: <{_line(value)}>" if column in ("record_id", "refers_to") else f"{name}: {_line(value)}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def member(raw: bytes, level: int = 4) -> bytes:
    """raw as a gzip member with its lengths in the extra field (0 where 32 bits can't hold them)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    total = 10 + 2 + SKIP.size + len(body) + 8
    fits = total < 1 << 32 and len(raw) < 1 << 32
    extra = SKIP.pack(b"sl", 8, *((total, len(raw)) if fits else (0, 0)))
    return GZIP + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def fields(head: bytes) -> dict[str, str]:
    """Name and value of header lines after the first, names in lower case; a repeated name has its first value, a line
    that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            out[name] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        name = key.strip().lower() if colon and key.strip().lower() not in out else None
        if name is not None:
            out[name] = value.strip()
    return out


class Opened:
    """An archive that is read by offsets, in windows."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        self.size, self.at, self.window = self.file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.window):
            self.file.seek(at)
            self.at, self.window = at, self.file.read(max(n, WINDOW))
        return self.window[at - self.at : at - self.at + n]


class Record:
    """A record at an offset: more() gives its bytes bit by bit, after() the offset of the next one."""

    def __init__(self, archive: Opened, at: int) -> None:
        self.archive, self.at, self.raw, self.ended = archive, at, b"", False
        self.gzip = archive.read(at, 3) == GZIP
        self.next = at
        if self.gzip:
            self.inflate, self.length = zlib.decompressobj(31), None
            start = archive.read(at, 12)
            if len(start) == 12 and start[3] & 4:
                extra = archive.read(at + 12, int.from_bytes(start[10:12], "little"))
                while len(extra) >= 4:
                    n = int.from_bytes(extra[2:4], "little")
                    if extra[:2] == b"sl" and n == 8:
                        self.length = SKIP.unpack(extra[: SKIP.size])[2] or None
                    extra = extra[4 + n :]

    def fail(self, why: str):
        raise ValueError(f"{self.archive.uri} at {self.at}: {why}")

    def more(self, n: int = HEAD) -> bytes:
        """Up to n further bytes of the record (of the file, if it isn't compressed); empty at its end."""
        while not self.ended:
            if not self.gzip:
                got = self.archive.read(self.next, min(n, self.archive.size - self.next))
                self.next += len(got)
                self.ended = not got
                return got
            feed = self.inflate.unconsumed_tail
            if not feed:
                feed = self.archive.read(self.next, min(max(n, HEAD), self.archive.size - self.next))
                self.next += len(feed)
                if not feed:
                    self.fail("the archive ends within a record")
            got = self.inflate.decompress(feed, n)
            if self.inflate.eof:
                self.ended, self.next = True, self.next - len(self.inflate.unused_data)
            if got:
                return got
        return b""

    def head(self, begin: int = 0) -> int:
        """Reads on until the headers that begin there are complete; where what follows them begins."""
        look = begin
        while (end := self.raw.find(END, look)) < 0:
            look = max(begin, len(self.raw) - 3)
            got = self.more()
            if not got:
                self.fail("headers without an end")
            self.raw += got
        return end + len(END)

    def through(self, end: int) -> bytes:
        """Bytes of the record up to end."""
        parts, have = [self.raw], len(self.raw)
        while have < end:
            got = self.more(max(HEAD, end - have))
            if not got:
                self.fail("the archive ends within a record")
            parts.append(got)
            have += len(got)
        self.raw = b"".join(parts)
        return self.raw[:end]

    def after(self, end: int) -> int:
        """The next record's offset; end: the length of this one's headers and block."""
        if not self.gzip:
            return self.at + end + len(END)
        if self.length:
            return self.at + self.length
        while self.more(1 << 16):
            pass
        return self.next


def matches_digest(digest: str, payload: bytes) -> bool | None:
    """Whether payload has a digest as headers state it (algorithm:hex or base32); None if the algorithm isn't known."""
    algorithm, _, value = digest.partition(":")
    if algorithm.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(algorithm.lower(), payload).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def scan(uri: str, start: int, end: int | None, columns: list[str], wanted, verify: bool = True) -> Iterator[dict]:
    """Rows (of columns) of the records that begin in [start, end) and whose headers are wanted."""
    archive = Opened(uri)
    at, end = start, archive.size if end is None else end
    body = "payload" in columns
    while at < end:
        if archive.read(at, 2) == b"\r\n":
            at += 2
            continue
        r = Record(archive, at)
        begin = r.head()
        if not r.raw.startswith(b"WARC/"):
            r.fail("no WARC record")
        named = fields(r.raw[: begin - len(END)])
        try:
            length = int(named["content-length"])
        except (KeyError, ValueError):
            r.fail("no Content-Length")
        row = {c: named.get(h.lower()) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].removeprefix("<").removesuffix(">")
        if wanted(row):
            if "headers" in columns:
                row["headers"] = list(named.items())
            if body or "payload_bytes" in columns:
                http = named.get("content-type", "").lower().startswith("application/http") and length > 0
                inner = r.head(begin) if http else begin
                has = row["record_type"] != "revisit"
                stated = fields(r.raw[begin : inner - len(END)]).get("content-length", "") if http else ""
                row["payload_bytes"] = begin + length - inner if has else int(stated) if stated.isdigit() else None
                if body:
                    row["payload"] = r.through(begin + length)[inner:] if has else None
                    if has and verify and row["payload_digest"] and matches_digest(row["payload_digest"], row["payload"]) is False:
                        r.fail("the payload doesn't have the digest of its header")
            yield {c: row[c] for c in columns}
        at = r.after(begin + length)


# --- the data source ----------------------------------------------------------------------------------------------------


def holds(f: Filter, row: dict) -> bool | None:
    """A pushed predicate on a row of headers, as SQL has it: None where a null leaves it open."""
    if isinstance(f, Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, In):
        return True if value in f.value else None if None in f.value else False
    if f.value is None:
        return None
    return {
        EqualTo: lambda: value == f.value,
        GreaterThan: lambda: value > f.value,
        GreaterThanOrEqual: lambda: value >= f.value,
        LessThan: lambda: value < f.value,
        LessThanOrEqual: lambda: value <= f.value,
        StringStartsWith: lambda: value.startswith(f.value),
        StringEndsWith: lambda: value.endswith(f.value),
        StringContains: lambda: f.value in value,
    }[type(f)]()


@dataclass
class Piece(InputPartition):
    """Ranges of archives that a task reads: (uri, start, end or None)."""

    ranges: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.columns = options["path"], columns
        self.verify = options.get("verify", "true").lower() == "true"
        self.bytes, self.tasks = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("parallelism", "1"))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if len(inner.attribute) == 1 and inner.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        """Ranges of about the same number of bytes: partitionBytes, or less where that gives each of the tasks some."""
        files = listing(self.path)
        ranges = [(uri, a, b) for uri, size, places in files for a, b in zip([0, *places], [*places, size]) if b > a]
        most = max(1, min(self.bytes, -(-sum(b - a for _, a, b in ranges) // self.tasks)))
        out, room = [], 0
        for uri, a, b in ranges:
            if room <= 0:
                out.append(Piece([]))
                room = most
            last = out[-1].ranges[-1] if out[-1].ranges else None
            if last and last[0] == uri and last[2] == a:
                out[-1].ranges[-1] = (uri, last[1], b)
            else:
                out[-1].ranges.append((uri, a, b))
            room -= b - a
        return out or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        def wanted(row: dict) -> bool:
            return all(holds(f, row) for f in self.filters)

        rows, size = [], 0
        for uri, a, b in partition.ranges:
            for row in scan(uri, a, b, self.columns, wanted, self.verify):
                rows.append(row)
                size += len(row.get("payload") or b"") + 200
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows, self.columns)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, self.columns)
        give_back()


def _batch(rows: list[dict], columns: list[str]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns], columns)


def _commits(fs: pafs.FileSystem, root: str) -> dict[str, dict]:
    """What the commits under root say, by name; those that another one replaces are left out."""
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    gone = {x for c in found.values() for x in c["replaces"]}
    return {name: c for name, c in sorted(found.items()) if name not in gone}


def listing(uri: str) -> list[tuple[str, int, list[int]]]:
    """(uri, bytes, places for splits) of the archives at uri: as committed, else every archive found there."""
    fs, root = pafs.FileSystem.from_uri(uri)
    base = uri.rstrip("/")
    info = fs.get_file_info(root)
    if info.is_file:
        return [(uri, info.size, [])]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if fs.get_file_info(f"{root}/{COMMITS}").type != pafs.FileType.NotFound:
        return [(f"{base}/{name}", size, places) for c in _commits(fs, root).values() for name, size, places in c["files"]]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    named = sorted((f.path[len(root) :].strip("/"), f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")))
    return [(f"{base}/{name}", size, []) for name, size in named if not any(p[:1] in "._" for p in name.split("/"))]


@dataclass
class Written(WriterCommitMessage):
    """(name, bytes, places for splits) of the archives a task made."""

    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes, self.split_bytes = int(options.get("fileBytes", FILE_BYTES)), int(options.get("splitBytes", SPLIT_BYTES))
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name = [], None, ""
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None:
                        name, size, places = f"{uuid.uuid4().hex}.warc.gz", 0, []
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    if size - (places[-1] if places else 0) >= self.split_bytes:
                        places.append(size)
                    made = member(record({c: batch[c][i].as_py() for c in batch.schema.names}, self.date))
                    out.write(made)
                    size += len(made)
                    if size >= self.file_bytes:
                        out.close()
                        done.append((name, size, places))
                        out = None
            if out is not None:
                out.close()
                done.append((name, size, places))
        except BaseException:
            _remove(fs, [f"{root}/{x}" for x in {name, *(d[0] for d in done)} if x])
            raise
        give_back()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        old = _commits(fs, root) if self.overwrite else {}
        name, files = f"{uuid.uuid4().hex}.json", sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{root}/{COMMITS}/.{name}") as out:
            out.write(json.dumps({"files": files, "replaces": list(old)}).encode())
        fs.move(f"{root}/{COMMITS}/.{name}", f"{root}/{COMMITS}/{name}")
        _remove(fs, [f"{root}/{f[0]}" for c in old.values() for f in c["files"]])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        _remove(fs, [f"{root}/{f[0]}" for m in messages if m is not None for f in m.files])


def _remove(fs: pafs.FileSystem, paths: list[str]) -> None:
    """Deletes files that no commit lists any more; one that is gone already, or stays, changes no result."""
    for p in paths:
        try:
            fs.delete_file(p)
        except OSError:
            continue


class WarcSource(DataSource):
    """Format `warc`. Options: path; reading: verify, partitionBytes, parallelism; writing: fileBytes, splitBytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        unknown = set(schema.names) - {f.split()[0] for f in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"archives have no column {sorted(unknown)}")
        return WarcReader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format `warc` and predicates that go down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return tuned(spark)


# --- pages --------------------------------------------------------------------------------------------------------------


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """A record for every page. Of pages with equal payloads (by SHA-256) of at least `least` bytes the one with the
    smallest id is a response, and so are others with that id; the rest revisit it, also where they have no id. Without any
    id in the group, and below that size, all are responses. A null payload is empty. A null URL leaves the header out."""
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    rows = rows.withColumn("payload_bytes", F.octet_length("text").cast("long"))
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeats = staged(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("sha", "first"), "repeats")
    if small_enough(repeats):
        rows = rows.join(F.broadcast(repeats), "sha", "left")
    else:
        rows = attach(rows.withColumn("run", spread("id", "target_uri")), repeats, ["sha"])
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.url_encode(c.cast("string")))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("id")), F.lit("urn:page")).alias("record_id"),
        "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("sha")).alias("payload_digest"),
        "payload_bytes",
        F.when(~again, F.col("text").cast("binary")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Writes records (columns of SCHEMA) to archives under path; an empty table makes a commit without archives."""
    registered(records.sparkSession)
    records.write.format("warc").mode(mode).options(**options).save(path)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, **options) -> DataFrame:
    """Records of the archives under path; only what schema names is read and inflated."""
    tasks = registered(spark).sparkContext.defaultParallelism
    return spark.read.format("warc").schema(schema).options(**{"parallelism": tasks} | options).load(path)


def pages_of(records: DataFrame, kind: str = "long", id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of records that page_records() gave."""
    page = lambda c: F.when(F.col(c).startswith("urn:page:"), F.url_decode(F.substr(c, F.lit(len("urn:page:") + 1)))).cast(kind)
    found = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", ""))
    return records.select(page("record_id").alias(id_col), "payload_bytes", found.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Writes every page to archives in the shared folder and reads them back: pages_of() the records. A response's digest
    and length are of the payload as read, a revisit's those in its headers. An empty table gives an empty result."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(page_records(pages, id_col, url_col, payload_col, least), path)
    kind = pages.schema[id_col].dataType.simpleString()
    wanted = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    return pages_of(read_warc(spark, path, wanted), kind, id_col)
