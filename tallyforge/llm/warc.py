"""WARC archives of a table's rows, one gzip member a record, and a sequential reader that verifies them.

Writing: each task writes archives of its own rows to the shared folder; a payload that an earlier-chosen
record already holds is written as a revisit of that record, without the payload. The manifest that
`write` returns names the files that count: a task that is run again writes files anew, and those of the
attempt that was lost are named nowhere.

Reading: a task goes through a file from its start and decompresses each member a block at a time. The
header's content-length frames the block, which ends the member; the digests of block and payload are
made while the bytes pass and compared with those of the header. Memory holds one block of the file and,
if payloads are wanted, the payloads of one batch. A record that is damaged becomes a row that says why,
and the reader goes on at the next member that begins a record.
"""

from __future__ import annotations

import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .shared import place, scratch, written

#: Bytes of payload from which on a repeated one is written as a revisit.
LEAST_REVISIT = 1000
#: Compressed bytes after which a task begins its next file.
FILE_BYTES = 256 << 20
#: Compressed bytes that are read at once, and the most that a step decompresses.
BLOCK = 1 << 18
#: The most bytes that the named fields of a record may take.
MOST_HEADER = 1 << 20
#: Records and bytes of payload that a batch holds, unless one payload alone has more.
BATCH, BATCH_BYTES = 4096, 8 << 20
#: Capture date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("member_bytes", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string()), ("payload", pa.binary())])


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _labelled(digest: bytes) -> str:
    return "sha1:" + b32encode(digest).decode()


def _hex(label: str | None) -> str | None:
    """The bare lower-case hex form of a SHA-1 label in base 32 or 16; None for other algorithms."""
    name, _, value = (label or "").partition(":")
    if name.lower() != "sha1":
        return None
    return b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def record_id(value: object) -> str:
    """The record's id of a row's id, of any type; rows without one share an id."""
    return "urn:no-row" if value is None else "urn:row:" + quote(str(value), safe="")


def row_id(record: Column) -> Column:
    """The row's id, as text, of a record's id; null where it has none."""
    return F.when(record.startswith("urn:row:"), F.url_decode(F.substr(record, F.lit(9))))


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", _labelled(sha1(block).digest())), ("Content-Length", str(len(block)))]
    named = b"".join(f"{name}: {value}\r\n".encode() for name, value in head if value is not None)
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(VERSION + b"\r\n" + named + b"\r\n" + block + b"\r\n\r\n") + member.flush()


def _uri(value: str | None) -> str | None:
    return value and "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def page_record(row_id: object, uri: str | None, payload: bytes, keeper: object = None, revisit: bool = False) -> bytes:
    """The gzip member of a response, or of a revisit of the record of `keeper`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<{record_id(row_id)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(uri)), ("WARC-Payload-Digest", _labelled(sha1(payload).digest())), ("Content-Type", HTTP)]
    if revisit:
        return _record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(keeper)}>")], http)
    return _record("response", fields, http + payload)


def write(df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of df in `folder`, a record a row; returns their manifest (file, records, bytes).

    Of equal payloads of `least` bytes or more the row of the largest id is the response, the others
    revisit it; smaller payloads are all responses. A null payload is empty; null ids are smaller than
    others, and where a payload's ids are all null each row is a response, as are repeated rows of the
    largest id. Blanks and control characters of a uri are percent-encoded, a null one is left out. Of
    an empty table there are no files. Other columns of df are not read. A payload is one value of its row.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.encode(text, "UTF-8").alias("payload"))
    # Smaller payloads have keys that nothing meets, spread by row.
    large = F.octet_length("payload") >= least
    rows = rows.withColumn("key", F.when(large, F.sha2("payload", 256)).otherwise(F.concat(F.lit("small "), F.xxhash64("id", "uri"))))
    # One row for each repeated payload; written, their size is known, and Spark broadcasts them below
    # its threshold. Beyond it payloads are dealt by key, and adaptive execution splits a hot one.
    held = rows.where(large).groupBy("key").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").select("key", "keeper")
    rows = rows.join(written(held, "held"), "key", "left").select("id", "uri", "payload", "keeper", (F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))).alias("revisit"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _opened(folder)
        out = name = None
        records = size = 0
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5))):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid4().hex}.warc.gz"
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    size = out.write(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(*(v.as_py() for v in row)))
                records += 1
                if size >= file_bytes:
                    out.close()
                    yield _manifest(f"{folder}/{name}", records, size)
                    out, records = None, 0
        if out is not None:
            out.close()
            yield _manifest(f"{folder}/{name}", records, size)

    return written(rows.mapInArrow(archives, "file string, records long, bytes long"), "manifest")


def _manifest(file: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [file], "records": [records], "bytes": [size]})


class Damaged(ValueError):
    """A record that isn't what its header says."""


class Reader:
    """The records of one archive in their order, as dicts of SCHEMA's columns."""

    def __init__(self, file: pa.NativeFile, name: str = "", payloads: bool = True):
        self.file, self.name, self.payloads = file, name, payloads
        self.held, self.at = b"", 0  # bytes that were read but not used, and the place of the first of them

    def _more(self) -> bytes:
        found = self.held or self.file.read(BLOCK)
        self.held = b""
        self.at += len(found)
        return found

    def _back(self, unused: bytes) -> None:
        self.held = unused
        self.at -= len(unused)

    def _member(self) -> Iterator[bytes]:
        member = zlib.decompressobj(31)
        data = b""
        while not member.eof:
            data = data or self._more()
            piece = member.decompress(data, BLOCK)
            if not (data or piece or member.eof):
                raise Damaged("the file ends within a member")
            data = member.unconsumed_tail
            if piece:
                yield piece
        self._back(member.unused_data)

    def _found(self, row: dict) -> None:
        pieces = self._member()
        head, rest = _until(pieces, b"", b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise Damaged("no WARC header")
        fields = _fields(head)
        row |= {"record_type": fields.get("warc-type"), "record_id": _bare(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "refers_to": _bare(fields.get("warc-refers-to"))}
        if not fields.get("content-length", "").isdecimal():
            raise Damaged("no content-length")
        left = int(fields["content-length"])
        block, payload, kept = sha1(), sha1(), []
        # The payload begins after the block's own header where the block is a message of HTTP.
        ahead = b"" if fields.get("content-type", "").startswith("application/http") else None
        http: dict[str, str] = {}
        size = 0
        while left or ahead:
            piece = rest or next(pieces, None)
            if piece is None:
                raise Damaged("the block is shorter than its content-length")
            piece, rest = piece[:left], piece[left:]
            left -= len(piece)
            block.update(piece)
            if ahead is not None:
                ahead += piece
                cut = ahead.find(b"\r\n\r\n")
                if cut < 0:
                    if not left or len(ahead) > MOST_HEADER:
                        raise Damaged("the block has no end of its HTTP header")
                    continue
                http, piece, ahead = _fields(ahead[:cut]), ahead[cut + 4 :], None
            payload.update(piece)
            size += len(piece)
            if self.payloads and piece:
                kept.append(piece)
        tail = rest
        for piece in pieces:
            tail += piece
            if len(tail) > 4:
                break
        if tail != b"\r\n\r\n":
            raise Damaged("the member doesn't end where its content-length says")
        stated = _hex(fields.get("warc-payload-digest"))
        if (given := _hex(fields.get("warc-block-digest"))) and given != block.hexdigest():
            raise Damaged("the block has another digest")
        if row["record_type"] == "revisit":
            row |= {"payload_bytes": int(n) if (n := http.get("content-length", "")).isdecimal() else None, "payload_digest": stated}
            return
        if stated and stated != payload.hexdigest():
            raise Damaged("the payload has another digest")
        row |= {"payload_bytes": size, "payload_digest": payload.hexdigest(), "payload": b"".join(kept) if self.payloads else None}

    def __iter__(self) -> Iterator[dict]:
        while True:
            start = self.at
            if not (first := self._more()):
                return
            self._back(first)
            row = dict.fromkeys(SCHEMA.names) | {"file": self.name, "offset": start}
            try:
                self._found(row)
            except (ValueError, zlib.error) as e:
                row["error"] = str(e)
                self._resume(start + 1)
            row["member_bytes"] = self.at - start
            yield row

    def _resume(self, start: int) -> None:
        """Goes to the next place from `start` on at which a member begins that holds a record."""
        self.file.seek(start)
        self.held, self.at = b"", start
        window = b""
        while data := self._more():
            window += data
            at = -1
            while (at := window.find(MAGIC, at + 1)) >= 0:
                place, read = self.at - len(window) + at, self.at
                self.file.seek(place)
                try:
                    begins = zlib.decompressobj(31).decompress(self.file.read(BLOCK), 5) == b"WARC/"
                except zlib.error:
                    begins = False
                self.file.seek(place if begins else read)
                if begins:
                    self.held, self.at = b"", place
                    return
            window = window[-2:]


def _until(pieces: Iterator[bytes], found: bytes, mark: bytes) -> tuple[bytes, bytes]:
    while (cut := found.find(mark)) < 0:
        piece = next(pieces, None)
        if piece is None or len(found) > MOST_HEADER:
            raise Damaged("the header has no end")
        found += piece
    return found[:cut], found[cut + len(mark) :]


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins blank goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _bare(value: str | None) -> str | None:
    return value and value.removeprefix("<").removesuffix(">")


def read(files: DataFrame, payloads: bool = False, file_col: str = "file") -> DataFrame:
    """The records (SCHEMA's columns) of the archives that `files` names, one a row; of a manifest, of a
    listing, or of any table of paths that the tasks can open. payload_bytes and payload_digest of a
    revisit are those of the payload it refers to, as its header states them; payload is null for it and
    where `payloads` is false. Damaged records have `error`, and null in what wasn't reached."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = _opened(name)
                with fs.open_input_file(at) as file:
                    for row in Reader(file, name, payloads):
                        held.append(row)
                        size += len(row["payload"] or b"")
                        if len(held) >= BATCH or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, SCHEMA)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)

    names = files.select(F.col(file_col).cast("string").alias("file")).where("file IS NOT NULL")
    # Files of one task each, as near as even dealing comes to it: their number, not their bytes, is counted.
    return names.repartition(max(1, names.count())).mapInArrow(work, from_arrow_schema(SCHEMA))



def resolved(records: DataFrame) -> DataFrame:
    """Records with payloads, where a revisit has the payload of the response it refers to; `error` says
    so if there is none of its digest."""
    own = records.where("record_type = 'response' AND error IS NULL").groupBy(F.col("record_id").alias("held"), F.col("payload_digest").alias("digest")).agg(F.first("payload").alias("held_payload"))
    found = records.join(own, (F.col("refers_to") == F.col("held")) & (F.col("payload_digest") == F.col("digest")), "left")
    revisit = F.col("record_type") == "revisit"
    lost = revisit & F.col("held").isNull() & F.col("error").isNull()
    return found.select(*[c for c in SCHEMA.names if c not in ("error", "payload")], F.when(lost, "no response of its digest").otherwise(F.col("error")).alias("error"), F.when(revisit, F.col("held_payload")).otherwise(F.col("payload")).alias("payload"))


def archived_and_read(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each row, read back from archives
    that are written for it and deleted. A damaged record is an error. See `write` for awkward rows."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    with scratch(spark, "warc"):
        records = read(write(df, place(spark, "archives"), id_col, uri_col, payload_col))
        whole = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("file", F.lit(": "), "error")))
        found = records.select(row_id(F.col("record_id")).cast(kind).alias(id_col), "payload_bytes", "payload_digest", whole.alias("record_type"), row_id(F.col("refers_to")).cast(kind).alias("refers_to"))
        return written(found.where(F.col("record_type") != "warcinfo"), "records", keep=True)


SQL = f"""
WITH held AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
judged AS (
  SELECT *, strlen(html) >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM keeper AS revisit FROM held)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN keeper END AS refers_to
FROM judged
"""
