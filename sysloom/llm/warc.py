"""WARC archives as a Spark data source, and pages archived with duplicates as revisits.

The reader plans one partition per file (a ``.warc`` cannot be cut safely within, as payloads may hold
WARC text themselves). Predicates on the record type and on header columns are pushed down: a record's
headers are parsed first, and the payload of a record that fails them, or that nobody asked for, is stepped
over. Files of this writer carry each member's compressed size in the gzip extra field ``sl``, so such a
payload isn't even inflated; in files of other writers it is inflated and dropped.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .shared import filesystem

READ_SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
BATCH_BYTES, BATCH_ROWS, CHUNK = 8 << 20, 2000, 1 << 20
#: Columns that the headers alone decide, so that predicates on them come before the payload.
HEADER_COLUMNS = {"record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest"}


# ---- writing ----------------------------------------------------------------------------------------
def member(data: bytes, level: int) -> bytes:
    """One gzip member whose extra field ``sl`` holds its compressed and raw size."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str | None, n_bytes: int, refers_to: str | None, payload: bytes) -> bytes:
    """A WARC/1.0 record; responses carry an HTTP head, revisits that head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {' '.join(uri.split())}")
    if digest:
        lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {refers_to}")
    block = http + (payload if kind != "revisit" else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.0\r\n".encode() + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Done(WriterCommitMessage):
    def __init__(self, own: str, final: str):
        self.own, self.final = own, final


class WarcWriter(DataSourceArrowWriter):
    """A task writes one file under a name of its own; the commit moves only the files of successful tasks."""

    def __init__(self, options):
        self.path, self.level = options["path"].rstrip("/"), int(options.get("level", "1"))
        self.job = uuid.uuid4().hex
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        own = f"{self.path}/_temporary-{self.job}-{part:05d}-{uuid.uuid4().hex}"
        store, at = filesystem(own)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        try:
            with store.open_output_stream(at, compression=None) as out:
                out.write(member(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), self.date.encode()), self.level))
                for batch in iterator:
                    names = ["record_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to"]
                    columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
                    payload = batch.column(batch.schema.get_field_index("payload"))
                    for i, (kind, rid, uri, digest, n, to) in enumerate(zip(*columns, strict=True)):
                        out.write(member(record(kind, rid, uri, self.date, digest, n, to, payload[i].as_py() or b""), self.level))
        except BaseException:
            store.delete_file(at)
            raise
        return _Done(own, f"{self.path}/part-{part:05d}-{uuid.uuid4().hex[:8]}.warc.gz")

    def commit(self, messages):
        for m in filter(None, messages):
            store, own = filesystem(m.own)
            store.move(own, filesystem(m.final)[1])
        self.abort(messages)

    def abort(self, messages):
        """Delete what this write has left: files of failed and doubled attempts."""
        from pyarrow import fs

        store, at = filesystem(self.path)
        for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if x.base_name.startswith(f"_temporary-{self.job}-"):
                store.delete_file(x.path)


# ---- reading ----------------------------------------------------------------------------------------
class _Plain:
    """Records of an uncompressed file: bytes on demand, skips by seeking."""

    def __init__(self, f):
        self.f, self.left = f, 0

    def records(self):
        while True:
            head = b""
            while b"\r\n\r\n" not in head:
                line = self.f.readline()
                if not line:
                    if head:
                        raise ValueError("a record ends within its headers")
                    return
                head = head + line if head or line.strip() else b""
            self.left = 0
            yield head
            if self.left:
                self.f.seek(self.left, 1)

    def start(self, n: int) -> None:
        self.left = n

    def body(self, n: int) -> bytes:
        self.left = 0
        data = self.f.read(n)
        if len(data) < n:
            raise ValueError("a record ends too early")
        return data


class _Gzip:
    """Records of a gzip file, however they are dealt to its members: one each, all in one, or across members.

    A payload that nobody wants is stepped over by its member's stored size, if the record ends with the member; else it
    is inflated and dropped.
    """

    def __init__(self, f):
        self.f, self.next, self.inflate, self.tail, self.raw, self.left = f, 0, None, b"", b"", 0

    def _more(self, n: int) -> bool:
        """Inflate up to ``n`` more bytes into ``raw``; False at the file's end."""
        while True:
            if self.inflate is None:
                self.f.seek(self.next)
                self.tail = self.f.read(64 << 10)
                if not self.tail.strip(b"\0"):
                    return False
                if self.tail[:3] != b"\x1f\x8b\x08":
                    raise ValueError("not a gzip member")
                said = len(self.tail) >= 24 and self.tail[3] & 4 and self.tail[12:14] == b"sl"
                self.size, self.whole = struct.unpack_from("<II", self.tail, 16) if said else (0, 0)
                self.inflate, self.used, self.inflated = zlib.decompressobj(31), len(self.tail), 0
            if not self.tail:
                self.tail = self.f.read(CHUNK)
                self.used += len(self.tail)
                if not self.tail:
                    raise ValueError("a gzip member ends too early")
            got = self.inflate.decompress(self.tail, n)
            self.tail = self.inflate.unconsumed_tail
            self.raw += got
            self.inflated += len(got)
            if self.inflate.eof:
                self.next += self.used - len(self.inflate.unused_data)
                self.inflate = None
            if got:
                return True

    def records(self):
        while True:
            self.raw = self.raw.lstrip(b"\r\n")
            while b"\r\n\r\n" not in self.raw:
                if not self._more(8 << 10):
                    if self.raw:
                        raise ValueError("a record ends within its headers")
                    return
                self.raw = self.raw.lstrip(b"\r\n")
            head, sep, self.raw = self.raw.partition(b"\r\n\r\n")
            self.left = 0
            yield head + sep
            ends = self.inflate is not None and self.size and (self.inflated - len(self.raw) + self.left + 4 - self.whole) % (1 << 32) == 0
            if ends and self.left > len(self.raw):
                self.next, self.inflate, self.raw = self.next + self.size, None, b""
            else:
                self._skip(self.left)

    def _skip(self, n: int) -> None:
        while n > len(self.raw):
            n, self.raw = n - len(self.raw), b""
            if not self._more(CHUNK):
                raise ValueError("a record ends too early")
        self.raw = self.raw[n:]

    def start(self, n: int) -> None:
        self.left = n

    def body(self, n: int) -> bytes:
        parts, self.left = [], 0
        while n > len(self.raw):
            parts.append(self.raw)
            n, self.raw = n - len(self.raw), b""
            if not self._more(CHUNK):
                raise ValueError("a record ends too early")
        parts.append(self.raw[:n])
        self.raw = self.raw[n:]
        return b"".join(parts)


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last] = value.strip()
    return out


def _passes(filters: list[Filter], row: dict) -> bool:
    def one(f: Filter) -> bool | None:
        if isinstance(f, Not):
            got = one(f.child)
            return None if got is None else not got
        v = row[f.attribute[0]]
        if isinstance(f, IsNull):
            return v is None
        if isinstance(f, IsNotNull):
            return v is not None
        if v is None:
            return None
        tests = {EqualTo: lambda: v == f.value, In: lambda: v in f.value, GreaterThan: lambda: v > f.value, GreaterThanOrEqual: lambda: v >= f.value, LessThan: lambda: v < f.value, LessThanOrEqual: lambda: v <= f.value, StringStartsWith: lambda: v.startswith(f.value), StringEndsWith: lambda: v.endswith(f.value), StringContains: lambda: f.value in v}
        return tests[type(f)]()

    return all(one(f) for f in filters)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.want, self.filters = options["path"].rstrip("/"), options.get("payload", "full"), []

    def pushFilters(self, filters):
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            ordered = isinstance(inner, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains, IsNull, IsNotNull))
            if ordered and len(inner.attribute) == 1 and inner.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, at = filesystem(self.path)
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        scheme = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        names = sorted(x.path for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", ".")))
        return [InputPartition(scheme + n) for n in names]

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        store, at = filesystem(partition.value)
        with store.open_input_file(at) as f:
            rows, size = [], 0
            for row in self._rows(_Gzip(f) if at.endswith(".gz") else _Plain(io.BufferedReader(f, CHUNK))):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _rows(self, source) -> Iterator[dict]:
        for head in source.records():
            h = parsed(head)
            fields = {k.lower(): v for k, v in h.items()}
            length = int(fields.get("content-length", 0))
            source.start(length)
            digest = fields.get("warc-payload-digest")
            row = {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "payload_digest": digest.rpartition(":")[2] if digest else None, "headers": list(h.items()), "payload": None, "payload_bytes": None}
            if not _passes(self.filters, row):
                continue
            if self.want == "none" and row["record_type"] != "revisit":
                yield row
                continue
            block = source.body(length)
            if fields.get("content-type", "").startswith("application/http"):
                http, _, payload = block.partition(b"\r\n\r\n")
                said = [x.partition(b":")[2] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
            else:
                payload, said = block, []
            revisit = row["record_type"] == "revisit"
            row["payload_bytes"] = int(said[0]) if revisit and said else None if revisit else len(payload)
            if self.want == "verify" and digest and not revisit and digest.startswith("sha1:"):
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["payload_digest"]:
                    raise ValueError(f"payload of {row['record_id']} does not match its digest")
            if self.want == "full" and not revisit:
                row["payload"] = payload
            yield row


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds])


class WarcSource(DataSource):
    """``spark.read.format("warc")``. Options: ``path``; ``payload`` full (default), verify (check digests,
    return sizes only) or none (headers only); on writing ``level`` and ``date``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it push predicates down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages ------------------------------------------------------------------------------------------
#: Groups of equal payloads that are broadcast at most, by their counted number; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write a record for every row of ``pages`` under ``path``.

    Of rows with equal payloads of at least ``min_bytes``, those with the smallest ``page_id`` are responses and
    the others revisits that refer to it. Null payloads are empty; null ids come after all others and are
    written as ``null``; rows repeated with one id are alike, so a repeated smallest row is a response each
    time. An empty table writes no record; further columns are not read.
    """
    from .shared import written

    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    groups = written(groups, "equal-payloads")
    if groups.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:
        rows = _first_by_shuffle(rows, groups)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= min_bytes)
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    out = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), rid("page_id").alias("record_id"), "target_uri", _base32("digest").alias("payload_digest"), "payload_bytes",
        F.when(revisit, rid("first")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def _first_by_shuffle(rows: DataFrame, groups: DataFrame, salts: int = 32) -> DataFrame:
    """``rows`` with the ``first`` of their digest. A digest may have most of the rows, so it is looked up on ids and digests alone,
    dealt by salts; payloads are moved once, by id and digest."""
    salt = F.pmod(F.xxhash64("page_id"), F.lit(salts))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = rows.select("page_id", "digest", salt.alias("salt")).distinct().join(spread.hint("merge"), ["digest", "salt"])
    found = found.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "first")
    same = rows["page_id"].eqNullSafe(found["__id"]) & (rows["digest"] == found["__digest"])
    return rows.join(found.hint("merge"), same, "left").drop("__id", "__digest")


def _base32(digest: str):
    """Base 32 of a 20-byte column: each five bits pick a letter."""
    bits = F.concat_ws("", *[F.lpad(F.conv(F.hex(F.substring(digest, i, 5)), 16, 32), 8, "0") for i in (1, 6, 11, 16)])
    return F.translate(bits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archived(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives under ``path``, from their records alone; payloads are checked against their digests."""
    register(spark)
    records = spark.read.format("warc").option("payload", "verify").load(path).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    of = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return records.select(of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", of("refers_to").alias("refers_to"))
