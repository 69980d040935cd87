"""WARC archives as a Spark data source, and pages written to one with equal payloads as revisits.

``WarcSource`` (short name ``warc``) writes and reads rows of ``COLUMNS``.  Writing: each task fills
files of at most about ``FILE_BYTES``, a gzip member for each record, under names of its own attempt;
the commit of the whole job renames them, so that a task may run again and an aborted job leaves no
archive.  The member's extra field ``sl`` holds its compressed and plain length.

Reading: the plan makes a partition of a large file and of each bundle of small ones, without opening
any.  A record's header is decoded first and compared with the pushed predicates (``record_type``,
``record_id``, ``date``, ``target_uri``, ``refers_to``, ``payload_digest``, ``content_type``); the block of a
record that is not wanted, and every payload with the option ``payload`` = ``false``, is passed over by
``sl`` without decoding it, or, in files that lack the field, decoded in pieces and thrown away.  Files may
also be plain, or one gzip stream of many records.  A task holds one record and one batch of
``BATCH_BYTES`` at a time.  A broken member, length or checksum raises an error.

``archive``: payloads of at least ``MIN_BYTES`` with equal bytes (by SHA-256 and length) are stored once,
with the smallest page_id; the others are revisits that refer to it and carry the payload's digest
and length in their header and HTTP head alone.  A payload that a third of all pages share costs one
partial count a task; its rows meet the plain side of a join, which Spark can split.

Rows: null html is empty; a null page_id comes after all others, and a record that refers to one refers
to null; of rows with the smallest page_id of a payload the one with the smallest url (null last) is the
response, and of rows equal in all three just one; a url's controls and blanks are percent-encoded in the
header; an empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: What a record is as a row.  payload_bytes is the full payload's, for a revisit too.
COLUMNS = "record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, content_type string, payload_bytes long, payload binary"
#: Payloads below this are never revisits.
MIN_BYTES = 100
#: A written file ends after this, and a read partition bundles small files up to it.
FILE_BYTES = 256 << 20
BUNDLE_BYTES = 32 << 20
#: Bytes read at once, and of payload in one Arrow batch.
PIECE = 64 << 10
BATCH_BYTES, BATCH_ROWS = 8 << 20, 5000
LEVEL = 4
#: Header names of the columns that predicates may name.
_NAMES = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
_HTTP = "application/http"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


# -- writing --------------------------------------------------------------------------------------


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member with its compressed and plain length in the extra field ``sl``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 12 + 12 + len(body) + 8
    if max(whole, len(data)) >= 1 << 32:  # lengths don't fit the field
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def record_bytes(row: dict) -> bytes:
    """A record of one row: WARC header, HTTP head for responses and revisits, payload."""
    kind, payload = row["record_type"] or "resource", row["payload"] or b""
    head = b""
    fields = [(_NAMES[c], row[c]) for c in _NAMES if c != "content_type" and row[c] is not None]
    stated = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    if kind in ("response", "revisit"):
        head = f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type'] or 'application/octet-stream'}\r\nContent-Length: {stated}\r\n\r\n".encode()
        fields.append(("Content-Type", f"{_HTTP};msgtype=response"))
    elif row["content_type"] is not None:
        fields.append(("Content-Type", row["content_type"]))
    if kind == "revisit":
        payload = b""
        fields.append(("WARC-Profile", _IDENTICAL))
    fields.append(("Content-Length", len(head) + len(payload)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"\r\n", head, payload, _END))


@dataclass
class Written(ds.WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = common.place(self.folder)
        fs.create_dir(at, recursive=True)
        names, sink, size = [], None, 0
        try:
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None:
                        names.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                        sink, size = fs.open_output_stream(f"{at}/.{names[-1]}", compression=None), 0
                        sink.write(member(record_bytes({c: None for c in _NAMES} | {"record_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n", "payload_bytes": None})))
                    made = member(record_bytes(dict(zip(batch.schema.names, row, strict=True))))
                    sink.write(made)
                    size += len(made)
                    if size >= FILE_BYTES:
                        sink.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        """Files of the attempts that count get their names; with overwrite, earlier archives go first."""
        fs, at = common.place(self.folder)
        if self.overwrite:
            for info in _archives(fs, at):
                fs.delete_file(info.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{at}/.{name}", f"{at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = common.place(self.folder)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{at}/.{name}")


# -- reading --------------------------------------------------------------------------------------


class Plain:
    """Bytes of a file in order; passing over seeks."""

    def __init__(self, file):
        self.file, self.held, self.size = file, b"", file.size()

    def more(self, most: int = PIECE) -> bytes:
        return self.file.read(most)

    def pass_over(self, n: int) -> None:
        if self.file.tell() + n > self.size:
            raise ValueError("a record ends beyond its file")
        self.file.seek(self.file.tell() + n)

    def until(self, mark: bytes, first: int = 1024) -> bytes | None:
        """Bytes up to and with the mark; None where nothing is left."""
        seen = 0
        while (k := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            got = self.more(first)
            if not got:
                if self.held.strip():
                    raise ValueError("a header ends beyond its file")
                return None
            self.held += got
        out, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return out

    def read(self, n: int) -> bytes:
        parts = [self.held[:n]]
        self.held, n = self.held[n:], n - len(parts[0])
        while n > 0:
            got = self.more()
            if not got:
                raise ValueError("a record ends beyond its file")
            parts.append(got[:n])
            self.held, n = got[n:], n - len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        k = min(n, len(self.held))
        self.held = self.held[k:]
        if n > k:
            self.pass_over(n - k)


class Gzip(Plain):
    """Decoded bytes of gzip members in order; a member whose rest isn't wanted is passed over unread
    where its header tells its lengths.  ``decoded`` counts the bytes that were inflated."""

    def __init__(self, file):
        super().__init__(file)
        self.raw, self.inflate, self.decoded = b"", None, 0

    def _raw(self, n: int) -> bytes:
        while len(self.raw) < n and (got := self.file.read(PIECE)):
            self.raw += got
        return self.raw[:n]

    def _drop(self, n: int) -> bytes:
        out = self._raw(n)
        if len(out) < n:
            raise ValueError("a gzip member ends beyond its file")
        self.raw = self.raw[n:]
        return out

    def _open(self) -> bool:
        head = self._raw(10)
        if not head:
            return False
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        begin, flags, self.end, self.plain = self.file.tell() - len(self.raw), head[3], None, None
        self._drop(10)
        if flags & 4:
            extra = self._drop(struct.unpack("<H", self._drop(2))[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    whole, self.plain = struct.unpack("<II", extra[4:12])
                    self.end = begin + whole
                extra = extra[4 + n :]
        for bit in (8, 16):
            if flags & bit:
                while self._drop(1) != b"\0":
                    pass
        if flags & 2:
            self._drop(2)
        self.inflate, self.made, self.crc = zlib.decompressobj(-15), 0, 0
        return True

    def more(self, most: int = PIECE) -> bytes:
        while True:
            if self.inflate is None and not self._open():
                return b""
            if not self.raw and not self._raw(1):
                raise ValueError("a gzip member ends beyond its file")
            out = self.inflate.decompress(self.raw, most)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.made, self.crc, self.decoded = self.made + len(out), zlib.crc32(out, self.crc), self.decoded + len(out)
            if self.inflate.eof:
                if struct.unpack("<II", self._drop(8)) != (self.crc, self.made & 0xFFFFFFFF):
                    raise ValueError("a gzip member's checksum or length is wrong")
                self.inflate = None
            if out:
                return out

    def pass_over(self, n: int) -> None:
        while n > 0:
            if self.inflate is not None and self.end is not None and self.plain - self.made <= n:
                n -= self.plain - self.made
                behind = self.file.tell() - self.end  # bytes of the next members that are here already
                if behind >= 0:
                    self.raw = self.raw[len(self.raw) - behind :]
                else:
                    if self.end > self.size:
                        raise ValueError("a gzip member ends beyond its file")
                    self.raw = b""
                    self.file.seek(self.end)
                self.inflate = None
                continue
            got = self.more(min(n, PIECE))
            if not got:
                raise ValueError("a record ends beyond its file")
            n -= len(got)


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a WARC or HTTP header by lower-case name; continued lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(stream: Plain, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    """Rows of the records that are wanted; nothing is decoded beyond the header of another."""
    while (head := stream.until(_END)) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = header_fields(head)
        row = {c: fields.get(n.lower()) for c, n in _NAMES.items()}
        length = int(fields["content-length"])
        if not wanted(row):
            stream.skip(length + len(_END))
            continue
        http = (row["content_type"] or "").startswith(_HTTP) and length > 0
        size = length
        if http:
            inner = stream.until(_END)
            size -= len(inner)
            told = header_fields(inner)
            row["content_type"] = told.get("content-type", row["content_type"])
            row["payload_bytes"] = int(told["content-length"]) if row["record_type"] == "revisit" and told.get("content-length", "").isdigit() else size
        else:
            row["payload_bytes"] = size
        if payload and row["record_type"] != "revisit":
            row["payload"] = stream.read(size)
            size = 0
        else:
            row["payload"] = None
        stream.skip(size + len(_END))
        yield row


_TESTS = {
    "EqualTo": lambda f, v: v is not None and v == f.value,
    "EqualNullSafe": lambda f, v: v == f.value,
    "In": lambda f, v: v is not None and v in f.value,
    "IsNull": lambda f, v: v is None,
    "IsNotNull": lambda f, v: v is not None,
    "StringStartsWith": lambda f, v: v is not None and v.startswith(f.value),
    "StringEndsWith": lambda f, v: v is not None and v.endswith(f.value),
    "StringContains": lambda f, v: v is not None and f.value in v,
    "GreaterThan": lambda f, v: v is not None and v > f.value,
    "GreaterThanOrEqual": lambda f, v: v is not None and v >= f.value,
    "LessThan": lambda f, v: v is not None and v < f.value,
    "LessThanOrEqual": lambda f, v: v is not None and v <= f.value,
}


def _archives(fs, at: str) -> list:
    found = fs.get_file_info(FileSelector(at, allow_not_found=True))
    return sorted((x for x in found if x.type == FileType.File and not x.base_name.startswith(".") and x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)


@dataclass
class Bundle(ds.InputPartition):
    paths: tuple[str, ...]


class WarcReader(ds.DataSourceReader):
    def __init__(self, folder: str, payload: bool, arrow: pa.Schema):
        self.folder, self.payload, self.arrow, self.pushed = folder, payload, arrow, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            of = f
            while type(of).__name__ == "Not":
                of = of.child
            # text compares by code point here and by UTF-8 bytes in Spark, which is the same order
            if type(of).__name__ in _TESTS and len(of.attribute) == 1 and of.attribute[0] in _NAMES and of.attribute[0] != "content_type":
                self.pushed.append(f)
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for f in self.pushed:
            no = False
            while type(f).__name__ == "Not":
                f, no = f.child, not no
            value = row[f.attribute[0]]
            if no and value is None and type(f).__name__ not in ("IsNull", "IsNotNull", "EqualNullSafe"):
                return False
            if _TESTS[type(f).__name__](f, value) == no:
                return False
        return True

    def partitions(self) -> list[Bundle]:
        fs, at = common.place(self.folder)
        out, held, size = [], [], 0
        for info in _archives(fs, at):
            held.append(info.path)
            size += info.size
            if size >= BUNDLE_BYTES:
                out.append(Bundle(tuple(held)))
                held, size = [], 0
        if held or not out:
            out.append(Bundle(tuple(held)))
        return out

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        fs, _ = common.place(self.folder)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                stream = (Gzip if path.endswith(".gz") else Plain)(file)
                for row in records(stream, self.wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)


class WarcSource(ds.DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``; option
    ``payload`` = ``false`` leaves payloads null and undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> WarcReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", to_arrow_schema(schema))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push predicates to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages ----------------------------------------------------------------------------------------


def page_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as rows of ``COLUMNS``: responses, and revisits of equal payloads."""
    common.shared_folder(pages.sparkSession)
    payload = F.encode(common.text_of("html"), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    place = F.struct(F.col("page_id").isNull().alias("p0"), "page_id", F.col("url").isNull().alias("p1"), "url")
    firsts = (
        own.where(F.col("size") >= min_bytes)
        .groupBy("digest", place.alias("place"))
        .count()
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min_by(F.struct("place", "count"), "place").alias("first"), F.sum("count").alias("n"))
        .where("n > 1")
        .select("of", F.col("first.place").alias("first"), F.col("first.count").alias("alike"))
        .checkpoint()  # a plain side of the join, so that Spark can split the rows of one payload
    )
    joined = own.withColumn("place", place).join(firsts, (F.col("digest") == F.col("of")) & (F.col("size") >= min_bytes), "left")
    first = F.col("of").isNull() | F.col("first").eqNullSafe(F.col("place"))
    rows = joined.withColumn("response", first)
    if not firsts.where("alike > 1").isEmpty():
        # Rows equal in id, url and payload: their payload is taken once, the others are made from its count.
        same = first & (F.coalesce("alike", F.lit(1)) > 1)
        group = ["page_id", "url", "digest", "size", "first", "alike"]
        once = joined.where(same).groupBy(*group).agg(F.min("payload").alias("payload"))
        copies = once.select(*group, "payload").withColumn("response", F.lit(True)).unionByName(
            once.select(*group, F.explode(F.sequence(F.lit(2), F.col("alike"))).alias("k")).drop("k").withColumn("payload", F.lit(None).cast("binary")).withColumn("response", F.lit(False))
        )
        rows = rows.where(~same).select(*copies.columns).unionByName(copies)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"\r", "%0D"), r"\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    return rows.select(
        F.when(F.col("response"), "response").otherwise("revisit").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        uri.alias("target_uri"),
        F.when(~F.col("response"), urn(F.col("first.page_id"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("size").alias("payload_bytes"),
        F.when(F.col("response"), F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> None:
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(folder)


def described(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each archived page, from the archives alone: size and digest of a response are those of
    its decoded payload, a revisit's are what its header says."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = spark.read.format("warc").load(folder).where("record_type = 'response'")
    heads = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit'")
    whole = whole.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.concat(F.lit("sha256:"), F.sha2("payload", 256))})
    return whole.drop("payload").unionByName(heads.drop("payload")).select(
        F.when(number("record_id") != "", number("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        F.substring("payload_digest", 8, 64).alias("payload_digest"),
        "record_type",
        F.when(number("refers_to") != "", number("refers_to")).cast("long").alias("refers_to"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for each page, then read the archives back."""
    folder = common.scratch_path(spark, "warc")
    archive(common.table(spark, sf_dir, "pages"), folder)
    return described(spark, folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS k,
  first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND k > 1 THEN first_id END AS refers_to
FROM r
"""
