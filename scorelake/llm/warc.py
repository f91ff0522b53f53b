"""WARC archives as a Spark data source, and a table of pages archived with revisit records for equal payloads.

`spark.read.format("warc")` plans whole files into partitions of a bounded size, takes predicates on the record type and on headers, reads a
record's headers first, and passes by what isn't wanted: a record that a predicate rules out, and every payload where the read schema has
none. Compressed records are gzip members that give their length in the header (the field `sl`), so passing by is a seek; members without it,
of other writers, are inflated to their end.

`df.write.format("warc")` writes records. A task writes files of its attempt's own name; the driver lists them in a manifest when all tasks
are done, and readers of a folder with a manifest read what it lists, so files of lost or repeated attempts count for nothing.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from scorelake.llm.common import drop, ship, shared_path, written

VERSION = b"WARC/1.1"
MANIFEST = "_records.json"
#: A written file is closed beyond this many bytes; a partition of files to read is about as many.
FILE_BYTES, PARTITION_BYTES = 256 << 20, 128 << 20
#: Bytes of an Arrow batch of records, a record more at most; and bytes read at a time.
BATCH_BYTES, READ_BYTES = 4 << 20, 1 << 16
#: Column: header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: content_length is that of the block; payload is what follows the HTTP headers of an HTTP block, else the whole block; http the headers.
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), "content_length long", "headers map<string,string>", "http string", "payload binary"])
MEMBER = b"\x1f\x8b\x08"
HEADER_END = re.compile(rb"\r\n\r\n")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow knows, by URI; a bare path is local."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def standard_digest(sha1: str) -> str:
    """A SHA-1 in hexadecimal digits as the standard's header has it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def header_value(headers: dict[str, str], column: str) -> str | None:
    """A column's value in the headers; a payload's SHA-1 in lower-case hexadecimal digits, other digests as they are."""
    value = headers.get(HEADERS[column].lower())
    if column == "payload_digest" and value is not None and re.fullmatch(r"sha1:[A-Z2-7]{32}", value):
        return base64.b32decode(value[5:]).hex()
    return value


def member(raw: bytes, level: int) -> bytes:
    """A gzip member whose extra field `sl` holds its length and that of its contents, as 8 bytes each."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(raw) + deflate.flush()
    extra = b"sl" + struct.pack("<HQQ", 16, 10 + 2 + 20 + len(body) + 8, len(raw))
    return MEMBER + b"\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Records:
    """The records of one file, one after the other; `wanted` judges headers, and only where it holds is a record's block read."""

    def __init__(self, file: object, wanted: object, blocks: bool):
        self.file, self.wanted, self.blocks = file, wanted, blocks
        self.passed = 0  # bytes that were passed by without being inflated

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        head = self._read(3)
        self.file.seek(0)
        yield from self._members() if head == MEMBER else self._plain(lambda n: self._read(n), self._skip)

    def _read(self, n: int) -> bytes:
        return bytes(self.file.read(n))

    def _skip(self, n: int) -> None:
        self.file.seek(self.file.tell() + n)
        self.passed += n

    def _plain(self, read: object, skip: object, limit: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
        held = b""
        while True:
            while not (found := HEADER_END.search(held)):
                more = read(READ_BYTES)
                if not more:
                    if held.strip():
                        raise ValueError("a WARC record breaks off in its headers")
                    return
                held = (held + more).lstrip(b"\r\n") if not held else held + more
            headers = self._headers(held[: found.start()])
            held = held[found.end() :]
            size = int(headers["content-length"])
            if self.blocks and self.wanted(headers):
                parts = [held]
                got = len(held)
                while got < size + 4 and (more := read(max(READ_BYTES, size + 4 - got))):
                    parts.append(more)
                    got += len(more)
                held = b"".join(parts)
                if len(held) < size:
                    raise ValueError("a WARC record breaks off in its block")
                yield headers, held[:size]
                held = held[size:].lstrip(b"\r\n")
            else:
                if self.wanted(headers):
                    yield headers, None
                if len(held) < size + 4:
                    skip(size + 4 - len(held))
                    held = b""
                else:
                    held = held[size:].lstrip(b"\r\n")

    def _headers(self, raw: bytes) -> dict[str, str]:
        lines = raw.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        out = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    def _members(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        at = 0
        while True:
            self.file.seek(at)
            raw = self._read(READ_BYTES)
            if not raw:
                return
            length = self._length(raw)
            if length is None:
                # Without a stated length members follow one another as one stream.
                self.file.seek(at)
                stream = Inflated(self._read)
                yield from self._plain(stream.read, stream.skip)
                return
            inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
            text = inflate.decompress(raw[:length], READ_BYTES)
            found = HEADER_END.search(text)
            headers = self._headers(text[: found.start()]) if found else None
            if headers is not None and not (self.blocks and self.wanted(headers)):
                self.passed += max(length - len(raw), 0)
                if self.wanted(headers):
                    yield headers, None
            else:
                rest = self._read(length - len(raw)) if length > len(raw) else b""
                text += inflate.decompress(inflate.unconsumed_tail + rest) + inflate.flush()
                found = HEADER_END.search(text)
                if not found or not inflate.eof:
                    raise ValueError("a WARC record breaks off")
                headers = self._headers(text[: found.start()])
                block = text[found.end() : found.end() + int(headers["content-length"])]
                if len(block) < int(headers["content-length"]):
                    raise ValueError("a WARC record breaks off in its block")
                if self.wanted(headers):
                    yield headers, block if self.blocks else None
            at += length

    @staticmethod
    def _length(raw: bytes) -> int | None:
        if raw[:3] != MEMBER or len(raw) < 32 or not raw[3] & 4 or raw[12:16] != b"sl\x10\0":
            return None
        return struct.unpack("<Q", raw[16:24])[0]


class Inflated:
    """The contents of gzip members, read as one stream."""

    def __init__(self, source: object):
        self.source, self.inflate, self.held = source, zlib.decompressobj(zlib.MAX_WBITS | 16), b""

    def read(self, n: int) -> bytes:
        while True:
            if not self.held:
                self.held = self.source(READ_BYTES)
                if not self.held:
                    return b""
            out = self.inflate.decompress(self.held, n)
            self.held = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.held, self.inflate = self.inflate.unused_data, zlib.decompressobj(zlib.MAX_WBITS | 16)
            if out:
                return out

    def skip(self, n: int) -> None:
        while n > 0 and (got := self.read(min(n, READ_BYTES))):
            n -= len(got)


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcSource(DataSource):
    """Format `warc`. Options: path; `compression` (gzip or none), `level`, `fileBytes` when writing; `partitionBytes` when reading.
    Predicates are pushed down where spark.sql.python.filterPushdown.enabled is set, as `read_warc` does."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, schema, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.columns = schema.fieldNames()
        known = dict(c.split(" ", 1) for c in SCHEMA.replace(", ", "\n").split("\n")) | {"content_length": "bigint"}
        for f in schema.fields:
            if known.get(f.name) != f.dataType.simpleString():
                raise ValueError(f"a WARC record has no {f.name} {f.dataType.simpleString()}")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes =, IN, LIKE 'x%' and IS NOT NULL on columns that are headers; Spark applies the others."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in HEADERS or not isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                yield f
                continue
            if isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "held", None))
            else:
                self.tests.append((column, "in", [f.value] if isinstance(f, EqualTo) else list(f.value)))

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            own = header_value(headers, column)
            if own is None or (kind == "in" and own not in value) or (kind == "starts" and not own.startswith(value)):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Files, of which small ones share a partition."""
        store, root = _opened(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [Files([root])]
        manifest = store.get_file_info(f"{root}/{MANIFEST}")
        if manifest.type == fs.FileType.File:
            with store.open_input_stream(manifest.path) as f:
                files = [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
            files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path))
        out, room = [], 0
        for path, size in files:
            if not out or room < size:
                out.append(Files([]))
                room = self.size
            out[-1].paths.append(path)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        payload = "payload" in self.columns
        blocks = payload or "http" in self.columns
        schema = pa.schema([(c, {"content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}.get(c, pa.string())) for c in self.columns])
        rows, size = [], 0
        store, _ = _opened(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for headers, block in Records(f, self.wanted, blocks):
                    rows.append(self._row(headers, block))
                    size += 200 + len(block or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _row(self, headers: dict[str, str], block: bytes | None) -> tuple:
        http = None
        if block is not None and headers.get("content-type", "").startswith("application/http"):
            end = HEADER_END.search(block)
            http, block = (block[: end.start()].decode("utf-8", "replace"), block[end.end() :]) if end else (block.decode("utf-8", "replace"), b"")
        special = {"content_length": int(headers["content-length"]), "headers": headers, "http": http, "payload": block}
        return tuple(special[c] if c in special else header_value(headers, c) for c in self.columns)


class WarcWriter(DataSourceArrowWriter):
    """Rows have record_type, record_id, target_uri, date and payload_digest, and may have refers_to, content_type, headers (more of them),
    http (headers of an HTTP block) and payload."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip, self.level = options.get("compression", "gzip") == "gzip", int(options.get("level", 1))
        self.size = int(options.get("fileBytes", FILE_BYTES))
        self.columns = schema.fieldNames()
        store, root = _opened(self.path)
        if not overwrite and store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            raise FileExistsError(f"{self.path} holds an archive")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        attempt, files, out, room = uuid.uuid4().hex, [], None, 0
        try:
            for b in iterator:
                for i in range(b.num_rows):
                    row = {c: b.column(k)[i].as_py() for k, c in enumerate(self.columns)}
                    raw = self._record(row)
                    if out is None or room < 0:
                        if out is not None:
                            out.close()
                        files.append([f"{attempt}-{len(files):05d}.warc{'.gz' if self.gzip else ''}", 0])
                        out, room = store.open_output_stream(f"{root}/{files[-1][0]}", compression=None), self.size
                    out.write(raw)
                    room -= len(raw)
                    files[-1][1] += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _record(self, row: dict) -> bytes:
        headers = {HEADERS[c]: row.get(c) for c in HEADERS if row.get(c) is not None}
        if re.fullmatch("[0-9a-f]{40}", row.get("payload_digest") or ""):
            headers[HEADERS["payload_digest"]] = standard_digest(row["payload_digest"])
        headers |= dict(row.get("headers") or {})
        block = row.get("payload") or b""
        if row.get("http") is not None:
            block = row["http"].encode() + b"\r\n\r\n" + block
        raw = record_bytes(headers, block)
        return member(raw, self.level) if self.gzip else raw

    def commit(self, messages: list) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(files).encode())
        keep = {name for name, _ in files}
        for i in store.get_file_info(fs.FileSelector(root)) if self.overwrite else []:
            if i.type == fs.FileType.File and i.base_name not in keep | {MANIFEST}:
                store.delete_file(i.path)

    def abort(self, messages: list) -> None:
        store, root = _opened(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                store.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options: object) -> DataFrame:
    """The records of an archive, a file or a folder of them, as `columns` of SCHEMA: without payload and http, no block is read."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options: object) -> None:
    """Records (columns as WarcWriter reads them) as an archive in the folder `path`, in place of one that is there."""
    register(records.sparkSession)
    records.write.format("warc").mode("overwrite").options(**options).save(path)


def archive_pages(pages: DataFrame, path: str, at: datetime = datetime(2024, 1, 1, tzinfo=UTC), least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options: object) -> None:
    """A record for each row of pages: of rows whose payloads (UTF-8, null as empty) are equal and of at least `least` bytes, that of the
    largest id is a response and the others are revisits of it, without a payload; all others are responses.

    Of rows that are alike in id and payload, and the largest, one is the response. Null ids are the least; a group of null ids only has one
    response too. A record's header X-Page-Id holds the id, X-Refers-To-Page-Id that of the response, and Content-Length among the HTTP
    headers the payload's whole length. An empty table makes an archive of no records; other columns aren't read.
    """
    text = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), text.alias("payload"), F.octet_length(text).alias("size"), F.sha1(text).alias("digest"))
    shared = rows.where(F.col("size") >= least)
    # Rows of one id and payload are counted first, so a group of copies is small before it meets in one task.
    each = shared.groupBy("digest", "id").agg(F.count("*").alias("n"))
    groups = each.groupBy("digest").agg(F.max(F.struct(F.col("id").isNotNull().alias("held"), "id", "n")).alias("best"), F.sum("n").alias("rows")).where("rows > 1")
    groups = written(groups.select("digest", F.col("best.id").alias("first"), F.col("best.n").alias("alike")), "payloads")
    placed = rows.join(groups.withColumn("shared", F.lit(True)), "digest", "left")
    shared_one = F.coalesce(F.col("shared"), F.lit(False))
    largest = F.col("id").eqNullSafe(F.col("first"))
    tied = placed.where(shared_one & largest & (F.col("alike") > 1))
    plain = placed.where(~shared_one | ~largest | (F.col("alike") == 1)).withColumn("revisit", shared_one & ~largest)
    columns = ["id", "url", "payload", "size", "digest", "first", "revisit", "copy"]
    plain = plain.withColumn("payload", F.when(~F.col("revisit"), F.col("payload"))).withColumn("copy", F.lit(0)).select(*columns)
    if not groups.where("alike > 1").isEmpty():
        # Rows of the largest id more than once: counted by URL, and one of them, of the least URL, is the response.
        urls = tied.groupBy("digest", "url").agg(F.count("*").cast("int").alias("n"), F.first("id").alias("id"), F.first("size").alias("size"), F.first("first").alias("first"))
        least_url = urls.groupBy("digest").agg(F.min(F.coalesce("url", F.lit(""))).alias("least"), F.max(F.col("url").isNull()).alias("none"))
        bodies = tied.groupBy("digest").agg(F.first("payload").alias("payload"))
        marked = urls.join(least_url, "digest").withColumn("main", F.when(F.col("none"), F.col("url").isNull()).otherwise(F.col("url") == F.col("least")))
        copies = marked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("revisit", ~(F.col("main") & (F.col("copy") == 0)))
        alike = copies.where("revisit").withColumn("payload", F.lit(None).cast("binary")).select(*columns)
        plain = plain.union(alike).union(copies.where("NOT revisit").join(bodies, "digest").select(*columns))

    stamp = at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    own_id = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    hexed = F.sha2(F.concat_ws(" ", own_id, "url", "digest", F.col("copy").cast("string")), 256)
    record_id = F.concat(F.lit("<urn:uuid:"), *(x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(hexed, a, b)]), F.lit(">"))
    headers = F.map_filter(
        F.map_from_arrays(F.array(F.lit("X-Page-Id"), F.lit("X-Refers-To-Page-Id"), F.lit("WARC-Profile")), F.array(F.col("id").cast("string"), F.when(F.col("revisit"), F.col("first").cast("string")), F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        lambda k, v: v.isNotNull(),
    )
    records = plain.select(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        record_id.alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(stamp).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.col("digest").alias("payload_digest"),
        headers.alias("headers"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string")).alias("http"),
        "payload",
    )
    write_warc(records, path, **options)
    drop(groups)


def archived_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of an archive of archive_pages. Responses are read whole, and their
    length and digest computed; revisits have them in their headers, and no payload to read."""
    header = lambda name: F.col("headers")[name.lower()]
    id_ = header("X-Page-Id").cast(id_type).alias("page_id")
    whole = read_warc(spark, path, "record_type string, headers map<string,string>, payload binary").where("record_type = 'response'")
    whole = whole.select(id_, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    again = read_warc(spark, path, "record_type string, payload_digest string, headers map<string,string>, http string").where("record_type = 'revisit'")
    length = F.regexp_extract("http", r"Content-Length: (\d+)", 1).cast("long")
    again = again.select(id_, length.alias("payload_bytes"), "payload_digest", "record_type", header("X-Refers-To-Page-Id").cast(id_type).alias("refers_to"))
    return whole.union(again)
