"""WARC archives as a Spark data source in Python.

``spark.read.format("warc").load(folder)`` plans one partition for each group of archive files, and reads
record by record: the header block first. Predicates on the record type and on header fields are pushed
into the scan, and a record that fails them is passed over without reading (plain files) or inflating
(compressed files that state member lengths) its payload. Payloads are only taken where the ``payload``
option asks for them, and are checked against their digest where ``verify`` does.

``df.write.format("warc").save(folder)`` writes archives of one gzip member a record. Each member states
its compressed and plain lengths in an extra field, so readers can step over it. Each task attempt writes
files of its own, named after the job; when the job commits, a manifest of its own lists those of
successful attempts, so a lost executor leaves nothing that counts. Appending leaves earlier archives,
of whatever writer, as they are; overwriting replaces them after the new ones are committed.

Archives of others are read as they come: plain, of one gzip member a record, or compressed as a whole,
with folded header lines, and digests of any kind (``verify`` checks the kinds that it knows).

Files are reached through Arrow's file systems, so local or mounted folders and the object stores that
Arrow knows both work; ``read_anywhere`` reads by Spark's own readers what only these can open.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from soilspark.llm.storage import stored

MAX_BROADCAST_DIGESTS = 500_000  # of payloads that several pages share; some 100 bytes each
LEAST_REVISIT_BYTES = 100
FILE_BYTES = 128_000_000
PARTITION_BYTES = 64_000_000
MANIFEST = re.compile(r"_manifest-([0-9a-f]{32})\.json")
OWN = re.compile(r"part-[0-9a-f]{32}-[0-9a-f]{32}\.warc\.gz")
DIGESTS = {"md5", "sha1", "sha256", "sha512"}
SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
_BLOCK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_LENGTHS = b"sl"  # gzip extra field: compressed and plain length of the member


# --- records -------------------------------------------------------------------------------------------------------------------------


def record(row: dict) -> bytes:
    """One record. ``row``: record_type, page_id, target_uri, payload (bytes, None for a revisit), payload_digest, payload_bytes, refers_to."""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row["page_id"]}|{row["target_uri"]}|{row["payload_digest"]}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if (uri := row["target_uri"]) is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
        if uri != uri.strip() or "\r" in uri or "\n" in uri:  # what a header line can't hold as it is
            lines.append("WARC-X-Target-URI-As-JSON: " + json.dumps(uri))
    if row["page_id"] is not None:
        lines.append(f"WARC-X-Page-ID: {row['page_id']}")
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"WARC-X-Payload-Bytes: {row['payload_bytes']}"]
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-X-Refers-To-Page-ID: {row['refers_to']}"]
    payload = row["payload"] or b""
    block = _BLOCK % row["payload_bytes"] + (payload if row["record_type"] != "revisit" else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """``data`` as one gzip member that states its lengths."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 12 + 12 + len(body) + 8
    extra = _LENGTHS + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    found: list[tuple[str, str]] = []
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and found:  # a folded line
            found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            found.append((name.strip().lower(), value.strip()))
    return dict(found)


def _number(value: str | None) -> int | None:
    return None if value is None or value == "None" else int(value)


def header(head: bytes) -> dict:
    """The columns that the header block gives, and its content length and kind. A SHA-256 digest in hex is given bare, others with their kind."""
    h = _fields(head)
    uri, exact, digest = h.get("warc-target-uri"), h.get("warc-x-target-uri-as-json"), h.get("warc-payload-digest")
    if digest and re.fullmatch("sha256:[0-9a-fA-F]{64}", digest):
        digest = digest[7:].lower()
    return {
        "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": json.loads(exact) if exact else uri, "page_id": _number(h.get("warc-x-page-id")),
        "refers_to": _number(h.get("warc-x-refers-to-page-id")), "payload_digest": digest or None, "payload_bytes": _number(h.get("warc-x-payload-bytes")),
        "length": int(h.get("content-length", 0)), "http": h.get("content-type", "").lower().startswith("application/http"), "cut": "warc-truncated" in h,
    }


def fits(digest: str, body: bytes) -> bool | None:
    """Whether a payload has the digest, in hex or base32; None if its kind is unknown."""
    kind, _, value = digest.rpartition(":")
    kind = kind.lower().replace("-", "") or "sha256"
    if kind not in DIGESTS:
        return None
    made = hashlib.new(kind, body).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


class _Plain:
    """Reads a plain archive: header, then the payload or a step over it."""

    def __init__(self, file):
        self.file, self.buffer = file, b""

    def head(self) -> bytes | None:
        while True:
            while self.buffer.startswith(b"\r\n"):  # more empty lines than there should be
                self.buffer = self.buffer[2:]
            if (end := self.buffer.find(b"\r\n\r\n")) > 0:
                break
            if not (more := self.file.read(65536)):
                if self.buffer.strip():
                    raise ValueError("the archive ends within a header")
                return None
            self.buffer += more
        out, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
        return out

    def block(self, n: int) -> bytes:
        while len(self.buffer) < n + 4:
            if not (more := self.file.read(max(65536, n + 4 - len(self.buffer)))):
                raise ValueError("the archive ends within a record")
            self.buffer += more
        out, self.buffer = self.buffer[:n], self.buffer[n + 4 :]
        return out

    def skip(self, n: int) -> None:
        if len(self.buffer) >= n + 4:
            self.buffer = self.buffer[n + 4 :]
        else:
            self.file.seek(self.file.tell() + n + 4 - len(self.buffer))
            self.buffer = b""


class _Members:
    """Reads an archive of gzip members: inflates as far as the header, then the rest or nothing of it."""

    def __init__(self, file):
        self.file, self.at, self.tail = file, 0, b""

    def head(self) -> bytes | None:
        self.file.seek(self.at)
        first = self.file.read(65536)
        if not first:
            return None
        self.size = struct.unpack("<I", first[16:20])[0] if first[3:4] == b"\x04" and first[12:14] == _LENGTHS else None
        self.inflate, self.plain, self.raw = zlib.decompressobj(31), b"", first
        while b"\r\n\r\n" not in self.plain:
            more = self._more(4096)
            if not more:
                raise ValueError("the archive ends within a header")
            self.plain += more
        out, _, self.plain = self.plain.partition(b"\r\n\r\n")
        return out

    def _more(self, n: int) -> bytes:
        out = b""
        while not out and not self.inflate.eof:
            if not self.raw:
                self.raw = self.file.read(65536)
                if not self.raw:
                    break
            out = self.inflate.decompress(self.raw, n)
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return out

    def block(self, n: int) -> bytes:
        parts, have = [self.plain], len(self.plain)
        while more := self._more(1 << 20):
            parts.append(more)
            have += len(more)
        if have < n or not self.inflate.eof:
            raise ValueError("the archive ends within a record")
        self._next()
        return b"".join(parts)[:n]

    def skip(self, n: int) -> None:
        if self.size is None:
            while self._more(1 << 20):
                pass
        self._next()

    def _next(self) -> None:
        self.at = self.at + self.size if self.size is not None else self.file.tell() - len(self.inflate.unused_data)


def _archive(file):
    start = file.read(14)
    file.seek(0)
    if start[:2] != b"\x1f\x8b":
        return _Plain(file)
    return _Members(file) if start[3:4] == b"\x04" and start[12:14] == _LENGTHS else _Plain(gzip.GzipFile(fileobj=file))


def records(file, wanted: Callable[[dict], bool] = lambda h: True, payload: bool = True, verify: bool = False) -> Iterator[dict]:
    """The records of an open archive that ``wanted`` takes by their header. ``verify``: a payload that doesn't fit its digest is an error.

    Digests of unknown kinds, and those of payloads that are cut or were sent in chunks, can't be checked and are passed over.
    """
    archive = _archive(file)
    while (head := archive.head()) is not None:
        found = header(head)
        length, http, cut = found.pop("length"), found.pop("http"), found.pop("cut")
        if not wanted(found):
            archive.skip(length)
            continue
        found["payload"] = None
        if found["record_type"] != "revisit" and (payload or verify):
            block = archive.block(length)
            top, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            if verify and found["payload_digest"] and not cut and b"transfer-encoding:" not in top.lower() and fits(found["payload_digest"], body) is False:
                raise ValueError(f"{found['record_id']}: the payload does not fit its digest")
            found["payload_bytes"] = len(body)
            found["payload"] = body if payload else None
        else:
            archive.skip(length)
        yield found


# --- data source ---------------------------------------------------------------------------------------------------------------------


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, IsNotNull: lambda v, f: True, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
}
_HEADER_COLUMNS = {"record_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest"}


def _listed(store: fs.FileSystem, found: list[fs.FileInfo]) -> set[str]:
    """The archives that the manifests among the files ``found`` list."""
    out: set[str] = set()
    for x in found:
        if MANIFEST.fullmatch(x.base_name):
            with store.open_input_stream(x.path) as f:
                out |= {f"{x.path.rpartition('/')[0]}/{n}" for n in json.loads(f.read())}
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in _HEADER_COLUMNS and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, found: dict) -> bool:
        return all((v := found[f.attribute[0]]) is not None and _TESTS[type(f)](v, f) for f in self.filters)

    def partitions(self):
        store, folder = _at(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        listed = _listed(store, found)
        infos = [x for x in found if x.path.endswith((".warc", ".warc.gz")) and (not OWN.fullmatch(x.base_name) or x.path in listed)]
        out, room = [], 0
        for x in sorted(infos, key=lambda x: x.path):
            if not out or room < x.size:
                out.append(Files([]))
                room = self.size
            out[-1].paths.append(x.path)
            room -= x.size
        return out or [Files([])]

    def read(self, partition: Files):
        store, _ = _at(self.path)
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for r in records(f, self.wanted, self.payload, self.verify):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if len(rows) == 5000 or size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.size = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        store, folder = _at(self.path)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{folder}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= self.size:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        store, folder = _at(self.path)
        names = {n for m in messages if m for n in m.names}
        store.create_dir(folder, recursive=True)
        before = store.get_file_info(fs.FileSelector(folder))
        with store.open_output_stream(f"{folder}/_manifest-{self.job}.json") as f:
            f.write(json.dumps(sorted(names)).encode())
        for x in before:
            lost = x.base_name.startswith(f"part-{self.job}-") and x.base_name not in names  # of attempts that were lost
            old = self.overwrite and x.base_name not in names and (x.base_name.endswith((".warc", ".warc.gz")) or MANIFEST.fullmatch(x.base_name))
            if lost or old:
                store.delete_file(x.path)

    def abort(self, messages):
        store, folder = _at(self.path)
        for m in messages:
            for n in m.names if m else []:
                store.delete_file(f"{folder}/{n}")


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(dict(self.options), overwrite)


# --- operators -----------------------------------------------------------------------------------------------------------------------


def resolved(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """The rows of ``pages`` (page_id, url, html) as records: of equal payloads of at least ``least`` bytes the smallest page_id is response, the others revisit it.

    Null html is an empty payload. Rows that repeat the smallest page_id are responses as well; where no row of a payload has an id, all are.
    What is joined are only the digests that several rows share, broadcast while there are at most ``MAX_BROADCAST_DIGESTS`` of them, so payloads stay in the
    tasks that read them; beyond that they are shuffled.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("payload_bytes") >= least).groupBy(F.unhex("payload_digest").alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # written first: else a join by shuffle would inherit its dealing by digest, which Spark can't split where many pages share one
    first = stored(shared.where("n > 1").select("digest", "first"), "first")
    near = F.broadcast(first) if first.count() <= MAX_BROADCAST_DIGESTS else first
    response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(near, F.unhex(rows["payload_digest"]) == near["digest"], "left").select(
        F.when(response, "response").otherwise("revisit").alias("record_type"), "page_id", "target_uri", F.when(response, F.col("payload")).alias("payload"),
        "payload_digest", "payload_bytes", F.when(~response, F.col("first")).alias("refers_to"),
    )


def write_archives(records_: DataFrame, path: str, overwrite: bool = False) -> None:
    """Archives of ``resolved`` records in the folder ``path``, beside those that it holds or in their place."""
    store, folder = _at(path)
    store.create_dir(folder, recursive=True)
    records_.sparkSession.dataSource.register(Warc)
    records_.write.format("warc").mode("overwrite" if overwrite else "append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records below ``path``, columns as in ``SCHEMA``; filters on record_type and header columns go into the scan. An empty folder gives no rows."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def read_anywhere(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The same by Spark's own file reader, for stores that Arrow doesn't reach. A file is held in memory whole."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = list(records(io.BytesIO(content.as_py()), payload=payload, verify=verify))
                for a in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 1000], schema=out)

    out = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


# DuckDB: what should come back, straight from the pages.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN id IS NULL OR page_id = id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN id IS NOT NULL AND page_id <> id THEN id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
