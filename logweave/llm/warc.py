"""WARC archives of pages: a writer that stores each payload once, and a sequential reader.

Every record is a gzip member of its own. The reader goes through a file in blocks of bytes: it inflates member after member,
takes the header lines, then as many bytes as Content-Length says, and checks both digests on the way, so that memory does not
depend on the size of a record or file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import handed_in_batches, join_hot, shared_uri, stored
from logweave.session import small_side

# A file is closed at this size. Rows that a worker takes at once, and bytes that the reader takes at once.
FILE_BYTES = 64 << 20
HANDED = 200
READ_BYTES = 1 << 18
# Header lines of one record, at most; longer ones are taken for damage.
HEADER_BYTES = 1 << 20

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
END = b"\r\n\r\n"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None) -> str:
    """Record id of a page: a UUID of version 8 that holds the id, so that it can be read back; the nil UUID for no id."""
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=0)}>"
    bits = page_id & (1 << 64) - 1
    number = 0x6C6F67776561 << 80 | 8 << 76 | (bits >> 62) << 64 | 2 << 62 | bits & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(urn: str) -> int | None:
    """The page id in a record id."""
    number = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if not number:
        return None
    bits = (number >> 64 & 3) << 62 | number & (1 << 62) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def _uri(url: str) -> str:
    """The address with blanks and control characters as percent codes, so that it stays on its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header alone; its digest and length are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_uri(url)}"]),
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {HTTP_TYPE}",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + END + block + END) + packer.flush()


class Damaged(ValueError):
    """A file does not hold what its headers say."""


class Members:
    """Inflated bytes of a file's gzip members, one member at a time."""

    def __init__(self, file):
        self.file, self.rest, self.place = file, b"", 0

    def __iter__(self) -> Iterator[Member]:
        while self.rest or self.fill():
            member = Member(self, self.place)
            yield member
            member.skip()

    def fill(self) -> bool:
        self.rest = self.rest or self.file.read(READ_BYTES)
        return bool(self.rest)


class Member:
    """One gzip member, inflated as far as asked for."""

    def __init__(self, members: Members, place: int):
        self.members, self.place = members, place
        self.inflate = zlib.decompressobj(31)
        self.ready = b""

    def more(self) -> bool:
        """Inflate a further piece; False at the member's end."""
        while not self.inflate.eof:
            if not self.members.fill():
                raise Damaged(f"the file ends inside the member at byte {self.place}")
            given = self.members.rest
            try:
                piece = self.inflate.decompress(given, READ_BYTES)
            except zlib.error as e:
                raise Damaged(f"member at byte {self.place}: {e}") from e
            self.members.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.members.place += len(given) - len(self.members.rest)
            if piece:
                self.ready += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to a mark, which is taken too."""
        while (end := self.ready.find(mark)) < 0:
            if len(self.ready) > HEADER_BYTES or not self.more():
                raise Damaged(f"no end of the header at byte {self.place}")
        out, self.ready = self.ready[:end], self.ready[end + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.ready and not self.more():
                raise Damaged(f"the record at byte {self.place} is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def skip(self) -> None:
        """Go to the member's end."""
        self.ready = b""
        while self.more():
            self.ready = b""


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(file, payloads: bool = True) -> Iterator[dict]:
    """All records of an open file in order: place, type, id, refers_to, uri, date, payload_bytes, payload_digest, payload.

    Digests are checked: of the block always, of the payload where the record holds it. ``payload`` is None for revisits and
    without ``payloads``, and then never in memory as a whole.
    """
    for member in Members(file):
        head = member.until(END)
        if not head.startswith(VERSION + b"\r\n"):
            raise Damaged(f"no record at byte {member.place}")
        fields = _fields(head)
        kind, block, body = fields["warc-type"], hashlib.sha1(), hashlib.sha1()
        http, kept, size = b"", [], -1
        for piece in member.exactly(int(fields["content-length"])):
            block.update(piece)
            if size < 0:
                http += piece
                end = http.find(END)
                if end < 0:
                    if len(http) > HEADER_BYTES:
                        raise Damaged(f"no HTTP header at byte {member.place}")
                    continue
                http, piece = http[:end], http[end + len(END) :]
                size = 0
            body.update(piece)
            size += len(piece)
            if payloads:
                kept.append(piece)
        if b"".join(member.exactly(len(END))) != END or member.ready or member.more():
            raise Damaged(f"the record at byte {member.place} is longer than its Content-Length")
        found = {"warc-block-digest": block} | ({} if kind == "revisit" else {"warc-payload-digest": body})
        for name, value in found.items():
            if fields[name] != f"sha1:{base64.b32encode(value.digest()).decode()}":
                raise Damaged(f"{name} of the record at byte {member.place} is wrong")
        told = int(_fields(http).get("content-length", size))
        if kind != "revisit" and told != size:
            raise Damaged(f"the payload at byte {member.place} is not as long as its header says")
        yield {
            "place": member.place,
            "type": kind,
            "id": fields["warc-record-id"],
            "refers_to": fields.get("warc-refers-to"),
            "uri": fields.get("warc-target-uri"),
            "date": fields["warc-date"],
            "payload_bytes": told,
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "payload": b"".join(kept) if payloads and kind != "revisit" else None,
        }


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first_id) of all pages: ``first_id`` is the smallest page_id with the same payload, null where
    that is the page itself or the payload is alone or smaller than ``least_bytes``.

    Payloads are the same if SHA-256 and length agree. Only groups of two or more are looked up, by broadcast while they
    are few, else by shuffle with the hot groups apart.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("same", F.concat_ws(":", F.octet_length("payload"), F.sha2("payload", 256)))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("same").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1"), "warc-groups")
    few = small_side(groups.select("same", "first_id"))
    if few is not None:
        met = rows.join(few, "same", "left")
    else:
        met = join_hot(rows, groups, ["same"], "n", how="left").drop("n")
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select("page_id", "url", "payload", F.when(~own, F.col("first_id")).alias("first_id"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) as files ``*.warc.gz`` below ``folder``; the manifest of files.

    The manifest has file, records and bytes. Of records with equal payloads of at least ``least_bytes`` the one with the
    smallest page_id is a response, the others are revisits of it. A null html is the empty payload; a null url leaves the target
    out; a null page_id is never the one referred to, unless the whole group has none, and then all are responses;
    rows that share the smallest id are all responses. Rows repeat as they are; an empty table writes no file; other columns
    are not read. ``date`` stands in every record, since pages have none. ``folder`` is a URI that pyarrow.fs opens on every
    executor; a file is written under another name and renamed, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, made, records, written = None, [], 0, 0

        def name() -> str:
            return f"pages-{part:06d}-{len(made):06d}.warc.gz"

        def close() -> None:
            out.close()
            store.move(f"{root}/{name()}.{attempt}", f"{root}/{name()}")
            made.append((name(), records, written))

        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "payload", "first_id")]
            for page_id, url, payload, first in zip(*columns):
                if out is None:
                    out, records, written = store.open_output_stream(f"{root}/{name()}.{attempt}", compression=None), 0, 0
                first = first.as_py()
                written += out.write(record(page_id.as_py(), url.as_py(), payload.as_py(), first, first is not None, date))
                records += 1
                if written >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        columns = list(zip(*made)) or [[]] * 3
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "records", "bytes"])

    with handed_in_batches(pages.sparkSession, HANDED):
        return stored(mark_revisits(pages, least_bytes).mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the files of a manifest: file, place, record_type, page_id, refers_to, uri, date, payload_bytes,
    payload_digest and payload (null for revisits and without ``payloads``). A damaged file stops the job.

    Files are opened where they are read, one file after the other.
    """
    names = ["file", "place", "record_type", "page_id", "refers_to", "uri", "date", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 2, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for file in batch["file"].to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for r in read_records(source, payloads):
                        other = r["refers_to"] and page_of(r["refers_to"])
                        rows.append((file, r["place"], r["type"], page_of(r["id"]), other, r["uri"], r["date"], r["payload_bytes"], r["payload_digest"], r["payload"]))
                        held += len(r["payload"] or b"")
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    shape = (
        "file string, place long, record_type string, page_id long, refers_to long, uri string, date string, "
        "payload_bytes long, payload_digest string, payload binary"
    )
    files = manifest.repartition(max(1, manifest.count()), "file").select("file")
    return files.mapInArrow(run, shape)


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` below the shared folder and read them back: a row per page, without the payloads."""
    folder = folder or shared_uri(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder, least_bytes), folder, payloads=False)
