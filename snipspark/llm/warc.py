"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Writing: rows (record_type, target_uri, record_id, refers_to, payload_digest, payload_bytes, date, content_type, payload)
become gzip members, one for each record, in one archive for each task, in any folder that pyarrow's file systems reach.
A member says in gzip's extra field `sl` how long it is, so that a reader can step over it. Mode overwrite removes the
folder's other archives when the job commits.
Reading: the planner lists the archives and cuts them into spans of bytes; a task reads the records whose member begins
in its span. Headers are parsed first: only the first bytes of a member are inflated for them. Predicates on all columns
but the payload are checked on the headers (pushed down by Spark, or given as the options `record_type` and
`uri_prefix`). A payload that isn't wanted, by a predicate or by the option `payload` = false, isn't read: the task seeks to
the next member. In archives of other writers, whose members don't tell their length, it is inflated in pieces that are dropped at
once. Plain archives (`.warc`) are read whole by one task each, which seeks past payloads that aren't wanted.

Cases: a null payload is written as an empty one; a null target_uri is left out and read as null; a null or missing date is
the time of writing. Fields are written on one line: line breaks in them become blanks. An empty table writes no record, and reading a
folder without archives gives an empty result. Unknown kinds of records are read like others. A truncated archive, a
member of several records and anything that isn't a record raise an error: nothing is left out silently.
"""

from __future__ import annotations

import base64
import hashlib
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from .common import scratch

SCHEMA = "record_type string, target_uri string, record_id string, refers_to string, payload_digest string, payload_bytes long, date string, content_type string, payload binary"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
ARROW = pa.schema([(f, pa.int64() if f == "payload_bytes" else pa.binary() if f == "payload" else pa.string()) for f in FIELDS])
#: Header names of the archive format by column; the last is an extension of ours.
HEADERS = {"record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "date": "WARC-Date", "content_type": "Content-Type", "payload_bytes": "WARC-Payload-Length"}
#: Fixed value: what a revisit of an equal payload says it is.
PROFILE = b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
#: A gzip member begins with a magic number and deflate; the flag of an extra field; that field's name here,
#: under which it holds the lengths of the member and of what it inflates to.
MEMBER, EXTRA, LENGTHS = b"\x1f\x8b\x08", 4, b"sl"
#: Bytes of a member that are inflated at once.
STEP = 1 << 16
SPAN = 64 << 20
#: Rows, and bytes of payloads, that a reader hands on at once.
ROWS, HELD = 500, 4 << 20
ENDINGS = (".warc.gz", ".warc")
#: Parts that the revisits of a payload are dealt to, so that those of a hot one don't meet in one task.
SALTS = 16


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value) -> bytes:
    return re.sub(r"[\r\n]+", " ", str(value)).encode()


def record(row: dict) -> bytes:
    """A record of the format, uncompressed: headers, an empty line, the block, two line ends."""
    payload = row.get("payload") or b""
    lines = [f"{HEADERS[c]}: ".encode() + one_line(("sha1:" if c == "payload_digest" else "") + str(row[c])) for c in HEADERS if row.get(c) is not None]
    lines += [PROFILE] * (row.get("record_type") == "revisit")
    return VERSION + b"\r\n".join([*lines, b"Content-Length: %d" % len(payload)]) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that tells its own length."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) >> 32:
        head = MEMBER + b"\0" * 5 + b"\0\xff"
    else:
        head = MEMBER + bytes([EXTRA]) + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, LENGTHS, 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def told_length(start: bytes) -> int | None:
    """How long a member is by its extra field, if that says so."""
    if len(start) < 12 or not start[3] & EXTRA:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", start, 10)[0]
    while at + 4 <= min(end, len(start)):
        size = struct.unpack_from("<H", start, at + 2)[0]
        if start[at : at + 2] == LENGTHS and size == 8 and at + 12 <= len(start):
            return struct.unpack_from("<I", start, at + 4)[0]
        at += 4 + size
    return None


def parsed(head: bytes) -> dict:
    """Columns from a record's header block."""
    given = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        given[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    if not head.startswith(b"WARC/"):
        raise ValueError(f"not a record: {head[:40]!r}")
    row = {c: given.get(h.lower().encode()) for c, h in HEADERS.items()}
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
    length = int(given.get(b"content-length", 0))
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] is not None else length
    row["length"] = length
    return row


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int
    plain: bool = False


@dataclass
class Written(WriterCommitMessage):
    path: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One archive; a task that is run again writes another, and only those of committed tasks get their final name."""
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name, count = f"_{uuid.uuid4().hex}.warc.gz.tmp", 0
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in iterator:
                columns = {c: b.column(c).to_pylist() if c in b.schema.names else [None] * b.num_rows for c in FIELDS}
                for i in range(b.num_rows):
                    row = {c: v[i] for c, v in columns.items()}
                    row["date"] = row["date"] or now
                    out.write(member(record(row)))
                    count += 1
        return Written(name, count)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        old = [x.path for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.is_file and x.path.endswith(ENDINGS)] if self.overwrite else []
        for m in messages:
            if m and m.records:
                system.move(f"{root}/{m.path}", f"{root}/{m.path[1:-4]}")
            elif m:
                system.delete_file(f"{root}/{m.path}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.path}")


class Source:
    """A stream with a buffer: bytes at a place, and how many were inflated so far. A step back of STEP bytes stays in the buffer."""

    def __init__(self, stream):
        self.stream, self.base, self.pos, self.buffer, self.inflated = stream, 0, 0, b"", 0

    @property
    def at(self) -> int:
        return self.base + self.pos

    def go(self, place: int) -> None:
        if not self.base <= place <= self.base + len(self.buffer):
            self.stream.seek(place)
            self.base, self.buffer = place, b""
        self.pos = place - self.base

    def fill(self, size: int) -> None:
        """Makes at least so many bytes from here on present, if there are."""
        if len(self.buffer) - self.pos >= size:
            return
        cut = max(self.pos - STEP, 0)
        held, present = [self.buffer[cut:]], len(self.buffer) - self.pos
        self.base, self.pos = self.base + cut, self.pos - cut
        while present < size and (more := self.stream.read(max(size - present, 1 << 20))):
            held.append(more)
            present += len(more)
        self.buffer = b"".join(held)

    def peek(self, size: int) -> bytes:
        self.fill(size)
        return self.buffer[self.pos : self.pos + size]

    def take(self, size: int) -> bytes:
        data = self.peek(size)
        self.pos += len(data)
        return data


def first_member(source: Source, start: int, end: int) -> bool:
    """Goes to the first member that begins in [start, end): gzip's mark, followed by a record's first line. False without one."""
    source.go(start)
    while source.at < end:
        data = source.peek(1 << 20)
        if source.at == 0 and not data.startswith(MEMBER):
            raise ValueError(f"not an archive: {data[:20]!r}")
        found = data.find(MEMBER)
        if found < 0:
            if len(data) < 1 << 20:
                return False
            source.go(source.at + len(data) - len(MEMBER) + 1)
            continue
        source.go(source.at + found)
        if source.at >= end:
            return False
        try:
            if zlib.decompressobj(31).decompress(source.peek(4096), len(VERSION)).startswith(b"WARC/"):
                return True
        except zlib.error:
            pass
        if source.at == 0:
            raise ValueError("the first member holds no record")
        source.go(source.at + 1)
    return False


def records(stream, start: int, end: int, wanted, payload: bool, source: Source | None = None):
    """Rows of the records whose member begins in [start, end); headers first, payloads only of wanted rows."""
    source = source or Source(stream)
    if not first_member(source, start, end):
        return
    while source.at < end and (head := source.peek(64)):
        if not head.startswith(MEMBER):
            raise ValueError(f"no member at byte {source.at}")
        begin, length = source.at, told_length(head)
        z, row, keep, data, body, seen = zlib.decompressobj(31), None, False, b"", [], 0
        while not z.eof:
            if row is not None and not keep and length:
                break
            given = z.unconsumed_tail or source.take(STEP)
            if not given:
                raise ValueError(f"the member at byte {begin} is truncated")
            out = z.decompress(given, STEP)
            source.inflated += len(out)
            if row is None:
                data += out
                if (cut := data.find(b"\r\n\r\n")) >= 0:
                    row, out = parsed(data[:cut]), data[cut + 4 :]
                    keep = payload and wanted(row)
            if row is not None:
                if keep:
                    body.append(out)
                seen += len(out)
        if row is None:
            raise ValueError(f"the member at byte {begin} holds no record")
        if z.eof:
            if seen > row["length"] + 4 or seen < row["length"]:
                raise ValueError(f"the member at byte {begin} holds {seen} bytes after its headers, not one record of {row['length']}")
            source.go(source.at - len(z.unused_data))
        else:
            source.go(begin + length)
        if wanted(row):
            row["payload"] = b"".join(body)[: row["length"]] if payload else None
            yield row


def plain_records(stream, wanted, payload: bool):
    """Rows of an archive that isn't compressed."""
    source = Source(stream)
    while source.peek(1):
        size = 4096
        while (cut := source.peek(size).find(b"\r\n\r\n")) < 0:
            if len(source.peek(size)) < size:
                raise ValueError(f"the record at byte {source.at} is truncated")
            size *= 2
        begin = source.at
        row = parsed(source.take(cut + 4)[:cut])
        if wanted(row):
            row["payload"] = source.take(row["length"]) if payload else None
            if payload and len(row["payload"]) < row["length"]:
                raise ValueError(f"the record at byte {begin} is truncated")
        source.go(begin + cut + 4 + row["length"])
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {begin} is truncated")
        if wanted(row):
            yield row


class Test:
    """A predicate on a column of the headers; null meets none."""

    def __init__(self, column: str, how: str, value):
        self.column, self.how, self.value = column, how, value

    def holds(self, row: dict) -> bool:
        x = row[self.column]
        if self.how == "null":
            return x is None
        return x is not None and COMPARED[self.how](x, self.value)


COMPARED = {"in": lambda x, v: x in v, "starts": str.startswith, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "known": lambda x, v: True}
RANGES = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.span = int(options.get("span", SPAN))
        self.tests = []
        if "record_type" in options:
            self.tests.append(Test("record_type", "in", set(options["record_type"].split(","))))
        if "uri_prefix" in options:
            self.tests.append(Test("target_uri", "starts", options["uri_prefix"]))

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(Test(column, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append(Test(column, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(Test(column, "starts", f.value))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.tests.append(Test(column, "null" if isinstance(f, IsNull) else "known", None))
            elif type(f) in RANGES and column == "payload_bytes":
                self.tests.append(Test(column, RANGES[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        shown = [x for x in found if x.is_file and x.path.endswith(ENDINGS) and not x.base_name.startswith("_")]
        zipped = [x for x in shown if x.path.endswith(".gz")]
        spans = [Span(x.path, s, min(s + self.span, x.size)) for x in zipped for s in range(0, x.size, self.span)]
        return [*spans, *(Span(x.path, 0, x.size, True) for x in shown if x not in zipped)] or [Span("", 0, 0)]

    def wanted(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)

    def read(self, partition: Span):
        if not partition.path:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as stream:
            held, size = [], 0
            found = plain_records(stream, self.wanted, self.payload) if partition.plain else records(stream, partition.start, partition.end, self.wanted, self.payload)
            for row in found:
                held.append(row)
                size += len(row["payload"] or b"")
                if len(held) >= ROWS or size >= HELD:
                    yield pa.RecordBatch.from_pylist(held, ARROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def page_records(pages: DataFrame) -> DataFrame:
    """Rows to write, one for each page; of equal payloads the largest page_id is the response, the others revisit it.

    Rows are known by payload, page_id and url (of equal ones as many are written as there are); nothing is numbered, so nothing depends on how
    a scan is split. Payloads are added up by their digests, before they are shuffled, to one row each, the response.
    Revisits carry no payload: they are counted by digest, page_id and url, and meet the response of their digest in
    SALTS parts. Of rows that repeat the largest page_id, the one with the largest url is the response. Null page_ids are responses only of
    payloads that no numbered page has. Columns other than page_id, url and html are ignored."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    page = F.struct("page_id", "url")
    hashed = pages.select(page.alias("page"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    responses = hashed.groupBy("sha").agg(F.max("page").alias("page"), F.first("payload").alias("payload"), F.count("*").alias("copies"))
    light = pages.select(page.alias("page"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    every = light.groupBy("sha", "page", "payload_bytes").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)))
    heads = light.groupBy("sha").agg(F.max("page").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    heads = heads.select("sha", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    others = every.join(heads, ["sha", "salt"]).withColumn("n", F.col("n") - F.when(F.col("page").eqNullSafe(F.col("first")), 1).otherwise(0)).where("n > 0")
    others = others.select("sha", "page", "payload_bytes", F.col("first.page_id").alias("first_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    none = F.lit(None)
    row = lambda df, kind, refers, size, body: df.select(
        F.lit(kind).alias("record_type"), F.col("page.url").alias("target_uri"), name("page.page_id").alias("record_id"), refers.alias("refers_to"), F.col("sha").alias("payload_digest"),
        size.alias("payload_bytes"), none.cast("string").alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), body.alias("payload"),
    )
    return row(responses, "response", none.cast("string"), F.octet_length("payload").cast("long"), F.col("payload")).unionByName(row(others, "revisit", name("first_id"), F.col("payload_bytes"), none.cast("binary")))


def base32(rows: DataFrame) -> DataFrame:
    """With the hexadecimal digests of a column payload_digest in the format's base 32, by Arrow batches."""

    def stage(batches):
        for b in batches:
            i = b.schema.names.index("payload_digest")
            given = pa.array([x and base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(i).to_pylist()], pa.string())
            yield b.set_column(i, "payload_digest", given)

    return rows.mapInArrow(stage, rows.schema)


def registered(spark) -> None:
    """Makes the format known to the session, and lets Spark hand its predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archived(pages: DataFrame) -> str:
    """The pages written as archives into a new shared folder: its path."""
    spark = pages.sparkSession
    registered(spark)
    path = scratch(spark)
    base32(page_records(pages)).write.format("warc").mode("append").option("path", path).save()
    return path


def op10(spark, sf_dir: str) -> DataFrame:
    path = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    back = spark.read.format("warc").option("path", path).load()
    number = lambda c: F.regexp_extract(c, "page:(-?[0-9]+)>", 1).try_cast("bigint")
    return read_digests(back).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def read_digests(back: DataFrame) -> DataFrame:
    """The records read, with the bytes and digest of responses measured again on the payload that was read."""

    def stage(batches):
        for b in batches:
            kinds, given, sizes = b.column("record_type").to_pylist(), b.column("payload_digest").to_pylist(), b.column("payload_bytes").to_pylist()
            for i, p in enumerate(b.column("payload").to_pylist()):
                if kinds[i] == "response":
                    given[i], sizes[i] = digest(p or b""), len(p or b"")
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("refers_to"), b.column("record_type"), pa.array(given, pa.string()), pa.array(sizes, pa.int64())], ["record_id", "refers_to", "record_type", "payload_digest", "payload_bytes"])

    return back.mapInArrow(stage, "record_id string, refers_to string, record_type string, payload_digest string, payload_bytes long")


ORACLE_OP10 = r"""
WITH p AS (SELECT row_number() OVER () AS uid, page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT *, sha1(b) AS s, octet_length(b) AS n FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM h),
x AS (SELECT *, ('0b' || array_to_string(list_transform(string_split(s, ''), lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '')) AS bits FROM r)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(bits[3 + 5 * k + j] AS INTEGER) << (4 - j))) AS BIGINT)]), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM x
"""
