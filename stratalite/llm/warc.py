"""WARC archives: written with one gzip member for each record, read back by byte ranges.

The reader is splittable. A task gets a range of bytes, looks for the gzip magic
in it, and takes a candidate for a record only if the member decodes to a WARC
header. It owns the records that start inside its range, and reads the last of
them beyond the range's end. Damaged members are passed over to the next magic.

Files are opened with ``pyarrow.fs``, so that any store it knows by URI will do.
Writing survives lost executors: each attempt of a task writes files of its own
name, and only those are read that the written list of files names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalite.session import ship

from .common import new_folder, written

#: First bytes of a gzip member that deflates; fixed by the format.
MAGIC = b"\x1f\x8b\x08"
#: Bytes that are read at once, and those of one range.
WINDOW, RANGE = 1 << 20, 64 << 20
#: Most bytes of a record's or an HTTP header, and most tasks that ranges are dealt over (a task reads several ranges beyond).
MOST_HEADER, MOST_TASKS = 1 << 20, 100_000
#: A file is closed beyond so many bytes.
ROLL = 1 << 30
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "path string, offset long, length long, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "header_digest string, payload_bytes long, payload_digest string, payload binary"
)


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_revisits(pages: DataFrame, key: str = "page_id", payload: str = "payload") -> DataFrame:
    """Add ``refers_to``: the greatest key with an equal payload of at least LEAST_REVISIT bytes, where it isn't the row's own.

    Only digests are grouped, and partly before the shuffle; payloads are shuffled
    once, for the join with the digests that several rows share. A null key among
    equal payloads refers to the greatest key, if there is one.
    """
    own = pages.withColumn("_same", F.when(F.octet_length(payload) >= LEAST_REVISIT, F.sha2(F.col(payload), 256)))
    shared = own.where(F.col("_same").isNotNull()).groupBy("_same").agg(F.max(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = own.join(shared, "_same", "left")
    return joined.withColumn("refers_to", F.when(F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_same", "_first")


def record_uri(prefix: str, key) -> str:
    return f"<{prefix}{'' if key is None else key}>"


def record(key, uri: str | None, payload: bytes, refers_to, prefix: str, date: str) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of the payload, not the payload."""
    clean = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in uri or "") or f"{prefix}{key}"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(prefix, key)}"]
    lines += [f"WARC-Target-URI: {clean}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(prefix, refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, prefix: str = "urn:page:", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the columns key, uri, payload (binary) and refers_to as records; returns the written list of files: path, bytes, records."""
    import pyarrow as pa

    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        done, out, at, n, name = [], None, 0, 0, ""
        for batch in batches:
            for key, uri, payload, refers_to in zip(*(batch.column(c) for c in ("key", "uri", "payload", "refers_to")), strict=True):
                if out is None:
                    name, at, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(key.as_py(), uri.as_py(), payload.as_py() or b"", refers_to.as_py(), prefix, date)
                out.write(data)
                at, n = at + len(data), n + 1
                if at >= ROLL:
                    out.close()
                    done.append((f"{folder}/{name}", at, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", at, n))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "records"])

    return written(pages.select("key", "uri", "payload", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class _Reader:
    """Bytes of a file from a position on. One window of the file is held, however long a record is."""

    def __init__(self, file, at: int):
        self.file = file
        self.seek(at)

    def seek(self, at: int) -> None:
        self.file.seek(at)
        self.start, self.pos, self.data = at, 0, b""

    @property
    def at(self) -> int:
        return self.start + self.pos

    def more(self) -> bool:
        """The next window, after the few bytes of this one that weren't used."""
        got = self.file.read(WINDOW)
        self.start, self.data, self.pos = self.at, self.data[self.pos :] + got, 0
        return bool(got)

    def find_magic(self) -> bool:
        """Go to the next gzip magic; False at the end of the file."""
        while (found := self.data.find(MAGIC, self.pos)) < 0:
            self.pos = max(self.pos, len(self.data) - len(MAGIC) + 1)
            if not self.more():
                return False
        self.pos = found
        return True

    def member(self, content: Content) -> bool:
        """Add what the gzip member that starts here holds to ``content``; False if it isn't a whole WARC record's."""
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if self.pos == len(self.data) and not self.more():
                return False
            part = self.data[self.pos : self.pos + 65536]
            self.pos += len(part)
            try:
                while part and not unpack.eof:
                    if not content.add(unpack.decompress(part, WINDOW)):
                        return False
                    part = unpack.unconsumed_tail
            except zlib.error:
                return False
            self.pos -= len(unpack.unused_data)
        return content.fields is not None


class Content:
    """What the pieces of a record's content add up to: header fields, and size, digest and (if kept) bytes of the payload.

    The payload is hashed as it is read. A header of over MOST_HEADER bytes can't be
    read; an HTTP header so long is taken for payload.
    """

    def __init__(self, keep: bool):
        self.fields: dict | None = None
        self.stated: int | None = None
        self.size, self.sha1, self.kept = 0, hashlib.sha1(), [] if keep else None
        self.head, self.left, self.http = bytearray(), 0, False

    def add(self, piece: bytes) -> bool:
        """False if this can't be a record."""
        if self.fields is None:
            cut = self._header(piece)
            if cut is None:
                return len(self.head) <= MOST_HEADER and (len(self.head) < 5 or self.head.startswith(b"WARC/"))
            if not cut[0].startswith(b"WARC/") or (fields := header_fields(cut[0])) is None:
                return False
            self.fields, piece = fields, cut[1]
            self.left, self.http = int(fields["content-length"]), fields.get("content-type", "").startswith("application/http")
        piece = piece[: self.left]
        self.left -= len(piece)
        if self.http:
            cut = self._header(piece)
            if cut is None and len(self.head) <= MOST_HEADER:
                return True
            head, piece = cut or (b"", bytes(self.head))
            stated = next((v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length"), b"")
            self.stated, self.http = int(stated) if stated.isdigit() else None, False
            self.head.clear()
        self.size += len(piece)
        self.sha1.update(piece)
        if self.kept is not None:
            self.kept.append(piece)
        return True

    def _header(self, piece: bytes) -> tuple[bytes, bytes] | None:
        """The header and what follows it, once its end is there."""
        known = max(0, len(self.head) - 3)
        self.head += piece
        at = self.head.find(b"\r\n\r\n", known)
        if at < 0:
            return None
        head, rest = bytes(self.head[:at]), bytes(self.head[at + 4 :])
        self.head.clear()
        return head, rest


def header_fields(head: bytes) -> dict | None:
    """The named fields of a record's header; None if it can't be read."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def records_in(file, start: int, stop: int, keep: bool) -> Iterator[tuple[int, int, Content]]:
    """(offset, length, content) of the records that start in the range."""
    reader = _Reader(file, start)
    while reader.find_magic() and reader.at < stop:
        at, content = reader.at, Content(keep)
        if reader.member(content):
            yield at, reader.at - at, content
        else:
            reader.seek(at + 1)


def _hex(digest: str | None) -> str | None:
    kind, _, value = (digest or "").partition(":")
    if kind != "sha1":
        return None
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``files`` (path, bytes), one row each, see RECORD.

    ``payload_digest`` and ``payload_bytes`` are of the payload that was read; a
    revisit has none, and shows what its header says of the full payload. Ranges are
    dealt evenly over as many tasks.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    types = spark.createDataFrame([], RECORD).schema
    out = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    for offset, length, content in records_in(file, start, stop, with_payload):
                        f, payload = content.fields, b"".join(content.kept or ())
                        stated, revisit = _hex(f.get("warc-payload-digest")), f["warc-type"] == "revisit"
                        size = content.stated if revisit else content.size
                        rows.append((path, offset, length, f["warc-type"], f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), stated, size, stated if revisit else content.sha1.hexdigest(), payload if with_payload and not revisit else None))
                        held += len(payload) * with_payload + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                            rows, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[] for _ in out], out, strict=True)], schema=out)

    starts = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop"))
    # a number of tasks that is named isn't made smaller by adaptive execution, which sees only the few bytes of the list
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(min(int(tasks), MOST_TASKS)).mapInArrow(run, types)


def archive_pages(pages: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Write a record for each page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload is the html in UTF-8, null being empty. Rows with equal page_id and
    payload are all responses if theirs is the greatest id; a null page_id stays null.
    """
    spark, prefix = pages.sparkSession, "urn:page:"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    planned = plan_revisits(rows).withColumnRenamed("page_id", "key")
    found = read(spark, write(planned, new_folder(spark, "warc"), prefix), range_bytes, with_payload=False)
    key = lambda c: F.regexp_extract(c, f"^<{prefix}(-?[0-9]+)>$", 1)
    number = lambda c: F.when(key(c) != "", key(c).cast("long"))
    return found.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM d
"""
