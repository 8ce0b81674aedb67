"""WARC archives written and read as a chunked record table.

A payload travels as rows of record and chunk number, so neither the writer nor
the reader holds a record: both stream a chunk at a time.  A chunk read back
carries the SHA-1 of all payload bytes up to its end, so the last chunk of a
record has the digest of the whole, and it is compared with the record's header.

Each task streams its rows into files of its own in a folder that all executors
share, one gzip member per record, another file after ``ARCHIVE_BYTES``.  The
manifest lists the files of the attempts that succeeded; a lost attempt leaves
files that nobody reads.

Of records with equal payloads of at least ``least_bytes`` the one with the
largest id is a ``response``; the others are ``revisit`` records that name it and hold the
HTTP header alone, whose Content-Length is that of the full payload.  Payloads
are matched by length and SHA-1.

Nulls: a null payload is an empty one; a null id is written as no id and comes
before all others.  Of rows that share both id and payload one is the response
and the others revisit it.  An empty table makes no archive and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F
from tierflow.operators.joins import BROADCAST_BYTES, broadcast_fits
from tierflow.workspace import scratch_dir

from .common import parts, slices, stored

#: Payload bytes of one row.
CHUNK_BYTES = 1 << 20
#: Compressed size after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"

_READ_BYTES = 1 << 20
_ID = re.compile(rb"<urn:x-page:(-?\d*):([A-Z2-7]*):(\d+)>")
_CHUNK_ROW = {
    "record_id": pa.int64(),
    "url": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "chunk": pa.int64(),
    "chunks_end": pa.bool_(),
    "bytes_so_far": pa.int64(),
    "digest_so_far": pa.string(),
    "data": pa.binary(),
}
_CHUNK_DDL = (
    "record_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, chunk bigint, chunks_end boolean, bytes_so_far bigint, "
    "digest_so_far string, data binary"
)


# --- which record holds a payload --------------------------------------------


def with_roles(
    records: DataFrame, least_bytes: int = 0, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``records`` (id, url, payload binary) with ``size``, ``sha1``, ``response``,
    ``refers_to`` and ``twin``, the number of a row among those equal in id and payload.
    """
    records = records.withColumns(
        {"size": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload")}
    )
    payload = ["size", "sha1"]
    # an equal id and payload may come several times: count, then take the largest
    ids = records.groupBy(*payload, "id").agg(F.count("*").alias("rows"))
    ids = stored(ids, "payloads")
    winners = (
        ids.where(F.col("size") >= least_bytes)
        .groupBy(*payload)
        .agg(F.max("id").alias("winner"), F.sum("rows").alias("known"))
        .where("known > 1")
    )
    winners = stored(winners, "winners")
    # where few payloads repeat, no payload has to move; beyond that they are shuffled
    few = broadcast_fits(winners, broadcast_bytes)
    joined = records.join(F.broadcast(winners) if few else winners, payload, "left")
    repeated = ids.where("rows > 1").select(*payload, F.col("id").alias("again"))
    twin = F.lit(0)
    if not repeated.isEmpty():
        same = [records[c].eqNullSafe(repeated[c]) for c in payload]
        matched = records["id"].eqNullSafe(repeated["again"])
        once = joined.join(repeated, [*same, matched], "left_anti").withColumn("twin", twin)
        order = Window.partitionBy(*payload, "id").orderBy("url")
        more = joined.join(repeated, [*same, matched], "left_semi")
        joined = once.unionByName(more.withColumn("twin", F.row_number().over(order) - 1))
    else:
        joined = joined.withColumn("twin", twin)
    short = F.col("known").isNull()
    first = F.col("id").eqNullSafe(F.col("winner")) & (F.col("twin") == 0)
    return joined.withColumn("response", short | first).withColumn(
        "refers_to", F.when(~F.col("response"), F.col("winner"))
    )


# --- writing -----------------------------------------------------------------


def write_archives(
    records: DataFrame,
    folder: str,
    least_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Archives of ``records`` (id bigint, url string, payload string or binary).

    Returns the manifest: ``path`` and ``records`` of every archive.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    records = records.select("id", "url", payload.alias("payload"))
    rows = with_roles(records, least_bytes, broadcast_bytes)
    last = F.when(
        F.col("response"), F.greatest(F.expr(f"(size - 1) div {chunk_bytes}"), F.lit(0))
    ).otherwise(F.lit(0))
    chunk = F.when(
        F.col("response"),
        F.substring(F.col("payload"), F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)),
    )
    # chunks of a record follow one another: nothing moves between here and the file
    chunks = rows.withColumn("last", last.cast("int"))
    chunks = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0), "last")))
    chunks = chunks.select(
        "id", "url", "size", "sha1", "response", "refers_to", "twin", "chunk", chunk.alias("data")
    )

    def run(batches):
        out = _Archives(folder, archive_bytes, date)
        for batch in slices(batches, "data"):
            for row in batch.to_pylist():
                out.add(row)
        yield pa.RecordBatch.from_pylist(
            out.close(), pa.schema([("path", pa.string()), ("records", pa.int64())])
        )

    return stored(chunks.mapInArrow(run, "path string, records bigint"), "manifest")


class _Archives:
    """The files one task writes."""

    def __init__(self, folder: str, limit: int, date: str):
        self.folder, self.limit, self.date = folder, limit, date
        self.done: list[dict] = []
        self.file = self.member = None
        self.systems: fs.FileSystem | None = None

    def add(self, row: dict) -> None:
        if row["chunk"] == 0:
            self._end_record()
            if self.file is None or self.file.tell() >= self.limit:
                self._next_file()
            self._begin(_header(row, self.date))
            self.done[-1]["records"] += 1
        if row["data"]:
            self.file.write(self.member.compress(row["data"]))

    def _begin(self, header: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.file.write(self.member.compress(header))

    def _end_record(self) -> None:
        if self.member is not None:
            self.file.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
            self.member = None

    def _next_file(self) -> None:
        if self.file is not None:
            self.file.close()
        name = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = fs.FileSystem.from_uri(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(path, compression=None)
        self.done.append({"path": name, "records": 0})
        block = b"software: tierflow\r\nformat: WARC File Format 1.1\r\n"
        self._begin(
            _fields(
                ("WARC-Type", "warcinfo"),
                ("WARC-Date", self.date),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                ("Content-Type", "application/warc-fields"),
                ("Content-Length", len(block)),
            )
            + block
        )
        self._end_record()

    def close(self) -> list[dict]:
        self._end_record()
        if self.file is not None:
            self.file.close()
        return self.done


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_name(number: int | None, digest: str, twin: int) -> str:
    return f"<urn:x-page:{'' if number is None else number}:{digest}:{twin}>"


def _fields(*fields: tuple[str, object]) -> bytes:
    lines = [b"WARC/1.1"]
    lines += [f"{name}: {_line(value)}".encode() for name, value in fields if value is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def _line(value: object) -> str:
    """A header value: control characters would end the line, so they are escaped."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _unline(value: str) -> str:
    return re.sub(r"%([0-7][0-9A-F])", lambda m: chr(int(m[1], 16)), value)


def _header(row: dict, date: str) -> bytes:
    digest = base32(row["sha1"])
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['size']}\r\n\r\n"
    ).encode()
    refers = None if row["response"] else _record_name(row["refers_to"], digest, 0)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return (
        _fields(
            ("WARC-Type", "response" if row["response"] else "revisit"),
            ("WARC-Date", date),
            ("WARC-Record-ID", _record_name(row["id"], digest, row["twin"])),
            ("WARC-Target-URI", row["url"]),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", None if row["response"] else profile),
            ("WARC-Refers-To", refers),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", len(http) + (row["size"] if row["response"] else 0)),
        )
        + http
    )


# --- reading -----------------------------------------------------------------


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunk table of the archives that ``manifest`` lists, one task per archive.

    A record gives at least one row.  ``chunks_end`` marks its last; there
    ``digest_so_far`` is of the whole payload.  Without ``data``, the bytes are
    read and digested but not returned.
    """
    types = dict(_CHUNK_ROW)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                held = 0
                for row in _records(path, chunk_bytes):
                    held += len(row["data"])
                    if not data:
                        row["data"] = None
                    rows.append(row)
                    if held >= 8 * chunk_bytes or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(types))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(types))

    spread = manifest.select("path").repartition(max(1, parts(manifest.sparkSession)))
    return spread.mapInArrow(run, _CHUNK_DDL)


class _Stream:
    """Bytes of a file of gzip members, as asked for."""

    def __init__(self, path: str):
        system, location = fs.FileSystem.from_uri(path)
        self.file = system.open_input_stream(location, compression=None)
        self.inflate = zlib.decompressobj(31)
        self.raw = b""
        self.buffer = b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(_READ_BYTES)
                if not self.raw:
                    return False
            made = self.inflate.decompress(self.raw, _READ_BYTES)
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
            if made:
                self.buffer += made
                return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line, None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("an archive ends within a record")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
        return out

    def take(self, size: int) -> bytes:
        pieces = []
        while size:
            if not self.buffer and not self._more():
                raise ValueError("an archive ends within a record")
            piece, self.buffer = self.buffer[:size], self.buffer[size:]
            pieces.append(piece)
            size -= len(piece)
        return b"".join(pieces)


def _records(path: str, chunk_bytes: int) -> Iterator[dict]:
    stream = _Stream(path)
    while (head := stream.head()) is not None:
        fields = _parsed(head)
        length = int(fields["content-length"])
        if fields["warc-type"] in ("response", "revisit"):
            http = stream.head()
            yield from _chunks(stream, fields, _parsed(http), length - len(http) - 4, chunk_bytes)
        else:
            while length:
                length -= len(stream.take(min(length, chunk_bytes)))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"a record of {path} is longer than its header says")


def _chunks(stream: _Stream, fields: dict, http: dict, size: int, chunk_bytes: int):
    number = _ID.fullmatch(fields["warc-record-id"].encode())[1]
    refers = fields.get("warc-refers-to")
    referred = _ID.fullmatch(refers.encode())[1] if refers else b""
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    url = fields.get("warc-target-uri")
    sha, so_far, chunk = hashlib.sha1(), 0, 0
    while True:
        data = stream.take(min(chunk_bytes, size - so_far))
        sha.update(data)
        so_far += len(data)
        now = base64.b32encode(sha.digest()).decode()
        end = so_far == size
        if end and fields["warc-type"] == "response" and now != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} has digest {now}")
        yield {
            "record_id": int(number) if number else None,
            "url": None if url is None else _unline(url),
            "record_type": fields["warc-type"],
            "refers_to": int(referred) if referred else None,
            "payload_bytes": int(http["content-length"]),
            "payload_digest": digest,
            "chunk": chunk,
            "chunks_end": end,
            "bytes_so_far": so_far,
            "digest_so_far": now,
            "data": data,
        }
        if end:
            return
        chunk += 1


def _parsed(head: bytes) -> dict[str, str]:
    pairs = (line.decode().partition(":") for line in head.split(b"\r\n")[1:])
    return {name.lower(): value.strip(" ") for name, _, value in pairs}


def round_trip(
    pages: DataFrame,
    least_bytes: int = 0,
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    **sizes: int,
) -> DataFrame:
    """One row per page, from archives written and read back.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``:
    size and digest of a response are of the bytes read, those of a revisit of
    its header.
    """
    records = pages.select(
        F.col(page).cast("bigint").alias("id"),
        F.col(url).cast("string").alias("url"),
        F.col(payload).alias("payload"),
    )
    folder = scratch_dir(pages.sparkSession, "warc")
    manifest = write_archives(records, folder, least_bytes, **sizes)
    whole = F.col("record_type") == "response"
    return (
        read_archives(manifest, data=False)
        .where("chunks_end")
        .select(
            F.col("record_id").alias("page_id"),
            F.when(whole, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(whole, F.col("digest_so_far"))
            .otherwise(F.col("payload_digest"))
            .alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
