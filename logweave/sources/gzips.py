"""Gzip files as lines, member by member: one file is read by many tasks, and what lies before and behind damage is kept.

A first pass finds the members: each task looks through a byte range of a file for headers and inflates from them; a member counts
if its checksum is right. A second pass reads the members in slices. A line may go on from one member into the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import settle
from logweave.sources.files import locate

# Compressed bytes that one task looks through for members, unpacked bytes that one task reads, bytes taken at once, bytes of a block of lines.
RANGE_BYTES = 64 << 20
SLICE_BYTES = 64 << 20
READ_BYTES = 1 << 18
BLOCK_BYTES = 1 << 20
# Lines of one block have this many bits of the line id.
BLOCK_BITS = 21

# How a gzip member starts; the upper three flag bits are zero.
MAGIC = b"\x1f\x8b\x08"

INDEX_SCHEMA = "path string, begin long, end long, size long, ends_line boolean, reason string"


class _Window:
    """Bytes of a file by place, read forward in pieces."""

    def __init__(self, file):
        self.file, self.length = file, file.size()

    def at(self, place: int, n: int = READ_BYTES) -> bytes:
        self.file.seek(place)
        return self.file.read(min(n, self.length - place)) if place < self.length else b""


def _candidate(file: _Window, place: int, stop: int) -> int | None:
    """The first place at or after ``place`` and before ``stop`` where a member may start."""
    while place < stop:
        data = file.at(place, READ_BYTES)
        k = data.find(MAGIC)
        while k >= 0:
            if place + k >= stop:
                return None
            if k + 3 >= len(data):
                break
            if not data[k + 3] & 0xE0:
                return place + k
            k = data.find(MAGIC, k + 1)
        if len(data) < READ_BYTES:
            return None
        place += max(1, (k if k >= 0 else len(data) - len(MAGIC)))
    return None


def _up_to_damage(gunzip, data: bytes) -> Iterator[bytes]:
    """What can be unpacked byte by byte, which a call that fails does not return."""
    for k in range(len(data)):
        try:
            piece = gunzip.decompress(data[k : k + 1])
        except zlib.error:
            return
        if piece:
            yield piece


def _inflate(file: _Window, place: int) -> Iterator[bytes | int]:
    """Unpacked pieces of the member at ``place``, then the place behind it. Raises at damage."""
    gunzip = zlib.decompressobj(31)
    while not gunzip.eof:
        data = file.at(place)
        if not data:
            raise EOFError("the file ends inside its compressed data")
        place += len(data)
        while data and not gunzip.eof:
            before = gunzip.copy()
            try:
                piece = gunzip.decompress(data, BLOCK_BYTES)
            except zlib.error:
                yield from _up_to_damage(before, data)
                raise
            data = gunzip.unconsumed_tail
            if piece:
                yield piece
    yield place - len(gunzip.unused_data)


def _find(path: str, low: int, high: int) -> Iterator[tuple]:
    """Members that start in a byte range: rows of the index. Damage gives a row with what could be unpacked before it."""
    fs, inner = locate(path)
    with fs.open_input_file(inner) as raw:
        file = _Window(raw)
        place: int | None = low
        sure = low == 0
        while place is not None and place < high:
            if not sure:
                place = _candidate(file, place, high)
                if place is None:
                    return
            size, last, end, reason = 0, b"\n", None, None
            try:
                for piece in _inflate(file, place):
                    if isinstance(piece, int):
                        end = piece
                    else:
                        size, last = size + len(piece), piece[-1:]
            except (EOFError, zlib.error) as e:
                reason = f"{type(e).__name__}: {e}"
            if end is not None:
                yield path, place, end, size, last == b"\n", None
                sure = file.at(end, 3) == MAGIC
                if not sure and not any(file.at(end, READ_BYTES)):
                    return  # padding, or the end
                place = end
            else:
                # A member that breaks off, or no member at all: its place will tell.
                yield path, place, None, size, last == b"\n", reason
                sure, place = False, place + 1


def index_members(files: DataFrame) -> DataFrame:
    """(path, begin, end, size, ends_line, reason) of all members of gzip files given as (path, length).

    Rows with a ``reason`` are members that break off: ``size`` bytes can be unpacked. A file that cannot be opened has a
    row of size 0. Each byte range of ``RANGE_BYTES`` is looked through by a task of its own.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, high in zip(*(batch[c].to_pylist() for c in ("path", "low", "high"))):
                try:
                    rows = list(_find(path, low, high))
                except OSError as e:
                    rows = [(path, 0, None, 0, True, f"{type(e).__name__}: {e}")] if low == 0 else []
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                names = ["path", "begin", "end", "size", "ends_line", "reason"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    low = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long")))
    ranges = files.select("path", low.alias("low")).withColumn("high", F.col("low") + RANGE_BYTES)
    cores = files.sparkSession.sparkContext.defaultParallelism
    found = ranges.repartition(max(cores, ranges.count()), "path", "low").mapInArrow(find, INDEX_SCHEMA)
    # What starts inside another member is text that looks like one; what breaks off is a member only where one must start.
    # One small row per member of a file goes through the window.
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    own = F.when(F.col("reason").isNull(), F.col("begin") >= F.col("reach")).otherwise(F.col("begin") == F.col("reach"))
    return settle(found.withColumn("reach", reach).filter(own).drop("reach"))


def _pieces(file: _Window, places: list[int], low: int, high: int, torn: bool) -> Iterator[bytes]:
    """Text of members ``low`` to ``high`` from their first whole line, with the end of the last line, wherever that is.

    ``torn``: the line before goes on into the first member, so the text up to its end is left out.
    """
    skip = torn
    ended = True
    for k in range(low, len(places)):
        if k >= high and (ended or skip):
            return
        try:
            for piece in _inflate(file, places[k]):
                if isinstance(piece, int):
                    continue
                if skip:
                    cut = _line_end(piece)
                    if not cut:
                        continue
                    piece, skip = piece[cut:], False
                if k >= high:
                    cut = _line_end(piece)
                    if cut:
                        yield piece[:cut]
                        return
                if piece:
                    ended = piece[-1:] == b"\n"
                    yield piece
        except (EOFError, zlib.error):
            # The text up to the damage is kept; the next member starts a line anew.
            if not ended and not skip:
                yield b"\n"
            ended, skip = True, False


def _line_end(piece: bytes) -> int:
    """Bytes up to and with the first line feed; 0 for none. Slices meet at line feeds only, whatever else ends lines."""
    return piece.find(b"\n") + 1


def _blocks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole lines, about ``BLOCK_BYTES`` at once; a line that is longer is one block."""
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size < BLOCK_BYTES:
            continue
        text = b"".join(held)
        # A carriage return at the very end may be the first half of a line end.
        cut = max(text.rfind(b"\n"), text.rfind(b"\r", 0, len(text) - 1)) + 1
        if cut:
            yield text[:cut]
            held, size = [text[cut:]], len(text) - cut
        else:
            held = [text]
    if text := b"".join(held):
        yield text


def gzip_lines(members: DataFrame) -> DataFrame:
    """(path, block_start, line_id, value) of all lines of indexed gzip files.

    Members of a file are read in slices of about ``SLICE_BYTES`` unpacked bytes. Lines end at ``\\n``, ``\\r\\n`` or ``\\r``; bytes that
    are no UTF-8 stay as they are. Of a damaged member the text up to the damage is kept.
    """
    members = members.filter("size > 0")
    order = Window.partitionBy("path").orderBy("begin")
    place = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A member that breaks off ends its line; a torn line goes on only from a whole member.
    whole = F.lag(F.col("ends_line") | F.col("reason").isNotNull(), 1, True).over(order)
    placed = members.withColumns({"slice": F.floor(place / F.lit(SLICE_BYTES)), "torn": ~whole, "k": F.row_number().over(order) - 1})
    slices = placed.groupBy("path", "slice").agg(
        F.min("begin").alias("block_start"), F.min("k").alias("low"), (F.max("k") + 1).alias("high"), F.min_by("torn", "begin").alias("torn"),
        F.array_sort(F.collect_list("begin")).alias("places"),
    )
    # A last line may go on into the members behind the slice: their places, too.
    after = Window.partitionBy("path").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    slices = slices.withColumn("next", F.flatten(F.collect_list("places").over(after)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = locate(row["path"])
                with fs.open_input_file(inner) as raw:
                    places = [*row["places"], *row["next"]]
                    pieces = _pieces(_Window(raw), places, 0, len(row["places"]), row["torn"])
                    for number, text in enumerate(_blocks(pieces)):
                        columns = [[row["path"]], [row["block_start"]], [number], [text]]
                        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "block_start", "number", "text"])

    slices = settle(slices.select("path", "block_start", "torn", "places", "next"))
    cores = slices.sparkSession.sparkContext.defaultParallelism
    spread = slices.repartition(max(cores, slices.count()), "path", "block_start")
    blocks = spread.mapInArrow(read, "path string, block_start long, number long, text binary")
    text = F.regexp_replace(F.col("text").cast("string"), r"(?:\r\n|\r|\n)\z", "")
    lines = blocks.select("path", "block_start", "number", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "value"))
    line_id = F.shiftleft(F.col("number"), BLOCK_BITS) + F.col("pos")
    return lines.select("path", "block_start", line_id.alias("line_id"), "value")


def gzip_rejects(members: DataFrame) -> DataFrame:
    """(path, reason, bytes_read) of files with damage: the first damage, and all bytes that could be unpacked."""
    broken = F.when(F.col("reason").isNotNull(), F.col("begin"))
    found = members.groupBy("path").agg(F.min_by("reason", broken).alias("reason"), F.sum("size").alias("bytes_read"))
    return found.filter(F.col("reason").isNotNull())
