"""WARC archives: records written with an index of byte ranges, read back by coalesced range reads.

Every task writes archive files of gzip members, one member a record, and returns the index of what it
wrote: file, offset, length, URL and payload digest of each record. Only the index of tasks that ended
is committed, so a file that a lost task left half written is named nowhere. A reader selects records in
the index first, sorts their ranges by file and offset, and fetches neighbouring ranges by one read.

Records of equal payloads are written once: the others are `revisit` records of the
identical-payload-digest profile, which keep the HTTP head of the response and name the record they
revisit. Record ids are UUIDs of version 8 that hold the page id and the beginning of the digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.llm.scratch import Scratch

INDEX = ("file string, offset long, length long, url string, digest string, page_id long, payload_bytes long, "
         "record_type string, refers_to long")
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Payloads below this many bytes are always written.
LEAST_BYTES = 1000
#: A file is closed when it is this long.
FILE_BYTES = 1 << 30
#: Ranges this near to each other are fetched together, up to ``READ_BYTES`` a read.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Archive bytes of one reading task.
TASK_BYTES = 64 << 20
#: A payload with more than this share of all records is hot: there are fewer such payloads than its inverse.
HOT_SHARE = 1 / 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it; Hadoop writes local paths as ``file:/``."""
    local = re.match(r"^(?:file:)?(/.*)$", uri)
    if local:
        return pafs.LocalFileSystem(), re.sub(r"^/+", "/", local[1])
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, sha1: bytes) -> str:
    """A UUID of version 8: 48 bits of the digest, a null mark, the 64 bits of the page id."""
    number = (page_id or 0) & 0xFFFFFFFFFFFFFFFF
    low = (0b10 << 62) | (number & ((1 << 62) - 1))
    middle = (8 << 12) | ((page_id is None) << 2) | (number >> 62)
    return f"<urn:uuid:{uuid.UUID(int=(int.from_bytes(sha1[:6]) << 80) | (middle << 64) | low)}>"


def page_of(record: str) -> int | None:
    """The page id in a record id."""
    value = uuid.UUID(record.strip("<>")[len("urn:uuid:"):]).int
    middle = (value >> 64) & 0xFFFF
    if middle & 4:
        return None
    number = ((middle & 3) << 62) | (value & ((1 << 62) - 1))
    return number - (1 << 64) if number >> 63 else number


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _member(head: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*head, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n"), packer.compress(block),
                     packer.compress(b"\r\n\r\n"), packer.flush()])


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, date: str, level: int = 6) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page in ``refers_to``."""
    sha1 = hashlib.sha1(payload).digest()
    own = record_id(page_id, sha1)
    # a page without URL is its own target
    target = own.strip("<>") if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", own), ("WARC-Date", date),
            ("WARC-Target-URI", target), ("WARC-Payload-Digest", _base32(sha1)),
            ("Content-Type", "application/http; msgtype=response")]
    if refers_to:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to[0], sha1)), ("WARC-Refers-To-Date", date)]
        return _member(head, http, level)
    return _member(head, http + payload, level)


def decode_record(member: bytes) -> tuple[dict, bytes]:
    """Header fields by lower-case name and the block of one gzip member, lengths checked."""
    content = zlib.decompress(member, 31)
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("the range holds no whole WARC record")
    return fields, rest[:length]


def _writer(folder: str, date: str, file_bytes: int, level: int):
    columns = ["page_id", "url", "payload", "digest", "payload_bytes", "revisit", "keeper"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        part = TaskContext.get().partitionId()
        out, name, at, rows = None, "", 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
            out = None

        def index():
            names = INDEX.replace(" string", "").replace(" long", "").split(", ")
            types = [pa.string() if f.endswith("string") else pa.int64() for f in INDEX.split(", ")]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        try:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in columns)):
                    page, url, payload, digest, size, revisit, keeper = (v.as_py() for v in row)
                    if out is None:
                        name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                        ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                                       b"format: WARC File Format 1.1\r\n", level)
                        out.write(info)
                        at = len(info)
                    record = encode_record(page, url, payload, (keeper,) if revisit else None, date, level)
                    out.write(record)
                    rows.append((f"{folder}/{name}", at, len(record), url, digest, page, size,
                                 "revisit" if revisit else "response", keeper if revisit else None))
                    at += len(record)
                    if at >= file_bytes:
                        close()
                    if len(rows) >= 10_000:
                        yield index()
                        rows = []
            close()
            if rows:
                yield index()
        finally:
            close()

    return write


def _with_keeper(rows: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """Add ``shared`` (another row has the payload too) and ``keeper``, the largest page id of the payload.

    A payload that many rows share meets its few siblings by a broadcast that is bounded by ``HOT_SHARE``,
    short payloads need no lookup: both stay where they are. The rest meets by a join on the digest.
    """
    # as one row of narrow counts per payload
    counted = scratch.keep(rows.where(F.col("payload_bytes") >= least).groupBy("content", "payload_bytes").agg(
        F.count("*").alias("copies"), F.max("page_id").alias("keeper")))
    total = counted.agg(F.sum("copies")).first()[0] or 0
    shared = counted.where("copies > 1").select("content", "payload_bytes", "keeper", "copies")
    hot = F.broadcast(shared.where(F.col("copies") > total * HOT_SHARE + 1).select(
        "content", "payload_bytes", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot")))
    marked = rows.join(hot, ["content", "payload_bytes"], "left")
    at_rest = F.col("hot").isNotNull() | (F.col("payload_bytes") < least)
    staying = marked.where(at_rest).withColumns({"keeper": F.col("hot_keeper"), "shared": F.col("hot").isNotNull()})
    cold = shared.where(F.col("copies") <= total * HOT_SHARE + 1).select(
        "content", "payload_bytes", "keeper", F.lit(True).alias("found"))
    moving = marked.where(~at_rest).join(cold, ["content", "payload_bytes"], "left").withColumn("shared", F.col("found").isNotNull())
    names = ["page_id", "url", "payload", "digest", "payload_bytes", "keeper", "shared"]
    return staying.select(*names).unionByName(moving.select(*names))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url",
                   payload_column: str = "html", least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z",
                   file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Write one WARC record per row below ``folder`` and return the index of all records, stored beside it.

    Of rows with equal payloads of at least ``least`` bytes those with the largest id are responses (repeated
    rows of that id all are), the others revisit them; a null id is smaller than any other. A null payload is
    empty; a null URL stays null; control characters, spaces and angle brackets of a URL are percent-encoded in
    the record, the index keeps the URL as it was. A long payload is one record and is held whole by one task.
    Other columns are ignored. An empty table gives an empty index and no file.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(f"`{payload_column}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"),
                        F.col(f"`{url_column}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"content": F.sha2("payload", 256), "digest": F.sha1("payload"),
                             "payload_bytes": F.octet_length("payload").cast("long")})
    known = _with_keeper(rows, scratch, least)
    revisit: Column = F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    known = known.withColumn("revisit", revisit).select(
        "page_id", "url", "payload", "digest", "payload_bytes", "revisit", "keeper")
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    index = scratch.keep(known.mapInArrow(_writer(folder, date, file_bytes, level), INDEX))
    scratch.free_others(index)
    return index


def _ranges(rows: Iterator[tuple], gap: int, most: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of sorted (file, offset, length) that one read fetches."""
    name, run = None, []
    for file, offset, length in rows:
        near = run and file == name and offset - (run[-1][0] + run[-1][1]) <= gap and offset + length - run[0][0] <= most
        if run and not near:
            yield name, run
            run = []
        name = file
        run.append((offset, length))
    if run:
        yield name, run


def _reader(payloads: bool, gap: int, most: int):
    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for name, run in _ranges(rows_of(batches), gap, most):
            if name != opened:
                fs, path = _filesystem(name)
                opened, source = name, fs.open_input_file(path)
            start = run[0][0]
            content = memoryview(source.read_at(run[-1][0] + run[-1][1] - start, start))
            out = []
            for offset, length in run:
                fields, block = decode_record(content[offset - start: offset - start + length])
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?im)^Content-Length: *(\d+)", http)[1])
                sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                kind, refers = fields["warc-type"], fields.get("warc-refers-to")
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != sha1):
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                own, target = fields["warc-record-id"], fields["warc-target-uri"]
                out.append((page_of(own), None if target == own.strip("<>") else target, size, sha1.hex(), kind,
                            page_of(refers) if refers else None)
                           + ((payload.decode(errors="replace") if kind == "response" else None,) if payloads else ()))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.record_batch(columns, names=names[: len(columns)])

    return read


def read_records(index: DataFrame, payloads: bool = False, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that ``index`` selects: page_id, url (as in the record), payload_bytes, payload_digest, record_type, refers_to.

    ``index`` is any selection of the rows that ``write_archives`` returned, repeated rows included. With ``payloads``
    the text of responses follows; a revisit has none of its own. Every payload is held against its digest.
    """
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    stretch = (F.col("offset") / F.lit(TASK_BYTES // 4)).cast("long")
    # a count of its own keeps small index rows with much behind them apart
    ordered = (index.select("file", "offset", "length").repartition(tasks, "file", stretch)
               .sortWithinPartitions("file", "offset"))
    return ordered.mapInArrow(_reader(payloads, gap, most), _RECORD + (", payload string" if payloads else ""))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by their index."""
    scratch = Scratch(spark, "archives")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{scratch.folder}/warc")
    records = scratch.keep(read_records(index))
    scratch.delete(f"{scratch.folder}/warc")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op13_warc": op13_warc}
SQL = {"op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""}
