"""Plain, gzip and zip logs as one Spark data source, for batches and for streams that follow growing files.

The source plans byte ranges, so one large file is read by many tasks. A stream's offset is the number of bytes taken of each
file; a micro-batch reads the ranges that were added since. A line belongs to the range that holds its line feed: the task reads back to
where the line began, and what has no line feed yet is left to the range that brings it. So an appended line arrives once, however
the file was cut by looks, ranges or the writer.
"""

from __future__ import annotations

import datetime
import json
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from logweave.sources.archives import _UNREADABLE, _member_lines, _members
from logweave.sources.files import _TEXT_NAME, LINES, locate
from logweave.sources.gzips import _blocks, _inflate, _Window

NAME = "log_lines"
SCHEMA = f"{LINES}, reason string"
# Line ids are places in the file, so stitching by these bits works on chunks of 4 MiB of text.
POSITION_BITS = 22
# Bytes of a plain file that one task reads, bytes read at once, bytes of one step back to the start of a line.
RANGE_BYTES = 128 << 20
# Tasks of a scan or a micro-batch before small ranges share one.
TASKS = 512
READ_BYTES = 1 << 20
BACK_BYTES = 1 << 16
SHORTER = "the file became shorter than what was read of it; it is read anew"

_LINE_END = re.compile(rb"\r\n|\r|\n")
_ZIP_NAME = re.compile(r"[^._].*\.zip(?:\.gz)?", re.IGNORECASE)
_ARROW = pa.schema(
    [
        ("source_path", pa.string()), ("source", pa.string()), ("block_start", pa.int64()), ("line_id", pa.int64()),
        ("value", pa.string()), ("base_date", pa.date32()), ("reason", pa.string()),
    ]
)


@dataclass
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file. A ``closed`` range ends a file that does not grow, so its last line needs no line
    feed; an ``anew`` range starts a file that was replaced."""

    path: str
    low: int
    high: int
    closed: bool = False
    anew: bool = False


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    parts: list[Range]


def shared(parts: list[Range]) -> list[Ranges]:
    """Ranges dealt to tasks: one each up to ``TASKS``, beyond that neighbours share a task as long as it has no more than
    ``RANGE_BYTES`` to read. So small ranges of much text do not make a task, and a file of a checkpoint, each."""
    most = min(max(sum(p.high - p.low for p in parts) // TASKS, 1), RANGE_BYTES) if len(parts) > TASKS else 0
    out: list[Ranges] = []
    room = 0
    for part in parts:
        size = part.high - part.low
        if out and size <= room:
            out[-1].parts.append(part)
            room -= size
        else:
            out.append(Ranges([part]))
            room = most - size
    return out


def _is_zip(path: str) -> bool:
    return _ZIP_NAME.fullmatch(unquote(path.rsplit("/", 1)[-1])) is not None


def _is_packed(path: str) -> bool:
    return path.lower().endswith(".gz") or _is_zip(path)


def listing(paths: Sequence[str]) -> dict[str, int]:
    """Length of every file among ``paths``, by path; folders are listed one level deep for log names, 7z archives and empty files left out."""
    found = {}
    for path in paths:
        path = path.rstrip("/")
        fs, inner = locate(path)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.File:
            head = path[: path.rfind("/") + 1]
            entries = [info]
        elif info.type == pafs.FileType.Directory:
            head = f"{path}/"
            entries = fs.get_file_info(pafs.FileSelector(inner))
            entries = [e for e in entries if e.is_file and (_TEXT_NAME.fullmatch(e.base_name) or _ZIP_NAME.fullmatch(e.base_name))]
        else:
            continue
        for e in entries:
            if e.size and not e.base_name.lower().endswith(".7z"):
                found[head + _quoted(e.base_name)] = e.size
    return found


def _quoted(name: str) -> str:
    """A name as it stands in the paths of Spark's file metadata."""
    return "".join(quote(c, safe="+!'(),;:@&=$~*") if c.isascii() else c for c in name)


def ranges(path: str, low: int, high: int, size: int, closed: bool = False, anew: bool = False) -> list[Range]:
    """A file's bytes in ranges of ``size``; packed files are one range."""
    step = max(high - low if _is_packed(path) else size, 1)
    return [Range(path, k, min(k + step, high), closed and k + step >= high, anew and k == low) for k in range(low, high, step)]


def _line_start(file: _Window, place: int) -> tuple[int, bytes]:
    """Where the line that holds byte ``place`` starts, and its bytes before that."""
    pieces: list[bytes] = []
    low = place
    while low > 0:
        step = min(BACK_BYTES, low)
        data = file.at(low - step, step)
        cut = data.rfind(b"\n") + 1
        pieces.append(data[cut:])
        low -= len(data) - cut
        if cut:
            break
    return low, b"".join(reversed(pieces))


def _range_text(file: _Window, low: int, high: int, closed: bool) -> Iterator[tuple[int, bytes]]:
    """(place, whole lines) of the lines that end in a byte range, about ``READ_BYTES`` at once."""
    begin, held, place = None, [], low

    def first() -> int:
        start, before = _line_start(file, low)
        held.insert(0, before)
        return start

    while place < high:
        data = file.at(place, min(READ_BYTES, high - place))
        if not data:
            break
        cut = data.rfind(b"\n") + 1
        if cut:
            begin = first() if begin is None else begin
            yield begin, b"".join([*held, data[:cut]])
            begin, held[:] = place + cut, [data[cut:]]
        else:
            held.append(data)
        place += len(data)
    if closed:
        begin = first() if begin is None else begin
        if text := b"".join(held):
            yield begin, text


def _split(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Lines of a text and where each starts. They end at ``\\n``, ``\\r\\n`` or ``\\r``, as for Spark's own text files."""
    if b"\r" not in text:
        body = text.removesuffix(b"\n")
        return body.split(b"\n"), np.append(0, np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1)
    values, starts, at = [], [], 0
    for end in _LINE_END.finditer(text):
        values.append(text[at : end.start()])
        starts.append(at)
        at = end.end()
    if at < len(text):
        values.append(text[at:])
        starts.append(at)
    return values, np.array(starts)


def _gzip_text(file: _Window, place: int, high: int) -> Iterator[bytes]:
    """Unpacked text of the members from ``place`` to ``high``."""
    while place < high and any(file.at(place, 1 << 12)):
        for piece in _inflate(file, place):
            if isinstance(piece, int):
                place = piece
            else:
                yield piece


def _kept(pieces: Iterator[bytes], damage: list[Exception]) -> Iterator[bytes]:
    """The pieces up to the damage, which is noted."""
    try:
        yield from pieces
    except (EOFError, zlib.error) as e:
        damage.append(e)


def _batch(path: str, source: str, block: int, starts, values: list, day, reason: str | None = None) -> pa.RecordBatch:
    n = len(values)
    # Bytes that are no UTF-8 stay as they are, as for Spark's own text files: no check by a cast.
    text = pa.array(values, pa.binary()).view(pa.string())
    columns = [
        pa.repeat(pa.scalar(path), n), pa.repeat(pa.scalar(source), n), pa.repeat(pa.scalar(block, pa.int64()), n),
        pa.array(starts, pa.int64()), text, pa.repeat(pa.scalar(day, pa.date32()), n), pa.repeat(pa.scalar(reason, pa.string()), n),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _source(path: str) -> str:
    """Display name of a file: its name, without ``.gz`` where a log name is left."""
    name = unquote(path.rsplit("/", 1)[-1])
    inner = name[:-3]
    return inner if name.lower().endswith(".gz") and inner.lower().endswith((".log", ".txt", ".zip", ".7z", ".gz")) else name


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """Lines of a range; what cannot be read gives a row with a ``reason`` and no value, behind the lines that could be read."""
    source, day, block, after = _source(part.path), None, 0, part.low
    try:
        fs, inner = locate(part.path)
        modified = fs.get_file_info(inner).mtime
        day = modified.astimezone(datetime.UTC).date() if modified else None
        if part.anew:
            yield _batch(part.path, source, block, [0], [None], day, SHORTER)
        with fs.open_input_file(inner) as raw:
            if _is_zip(part.path):
                for frame in _member_lines(part.path, _members(part.path, raw)):
                    for (place, member, reason), rows in frame.groupby(["archive", "member", "reason"], dropna=False, sort=False):
                        failed = isinstance(reason, str)
                        values = [None if failed else v.encode() for v in rows["value"]]
                        name = member if isinstance(member, str) else source
                        yield _batch(place, name, block, rows["line_id"].to_numpy(), values, day, reason if failed else None)
                return
            file = _Window(raw)
            if _is_packed(part.path):
                block, after = part.low, 0
                damage: list[Exception] = []
                for text in _blocks(_kept(_gzip_text(file, part.low, part.high), damage)):
                    values, starts = _split(text)
                    yield _batch(part.path, source, block, starts + after, values, day)
                    after += len(text)
                if damage:
                    raise damage[0]
                return
            for place, text in _range_text(file, part.low, part.high, part.closed):
                values, starts = _split(text)
                yield _batch(part.path, source, block, starts + place, values, day)
    except _UNREADABLE as e:
        yield _batch(part.path, source, block, [after], [None], day, f"{type(e).__name__}: {e}")


class LogLines(DataSource):
    """The data source; options ``paths`` (JSON list of files and folders) and ``rangebytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[list[str], int]:
        return json.loads(self.options["paths"]), int(self.options.get("rangebytes", RANGE_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Whole(*self._arguments())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(*self._arguments())


class _Whole(DataSourceReader):
    """All lines of the files as they are now."""

    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[Ranges]:
        found = sorted(listing(self.paths).items())
        # Spark needs a partition to read, also of nothing.
        return shared([r for path, length in found for r in ranges(path, 0, length, self.size, closed=True)]) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return (batch for part in partition.parts for batch in read_range(part))


class _Growing(DataSourceStreamReader):
    """Lines as they are added. An offset is the length of every file at a look, by path."""

    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(sorted(listing(self.paths).items()))

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        out = []
        for path, length in end.items():
            low = start.get(path, 0)
            if length < low:
                out += ranges(path, 0, length, self.size, anew=True)
            elif length > low and not (low and _is_zip(path)):
                out += ranges(path, low, length, self.size)
        return shared(out)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return (batch for part in partition.parts for batch in read_range(part))


def _options(spark: SparkSession, paths: str | Sequence[str], range_bytes: int) -> dict[str, str]:
    """Options of the source for the paths that exist, written as URIs."""
    spark.dataSource.register(LogLines)
    full = []
    for path in [paths] if isinstance(paths, str) else paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        uri = fs.makeQualified(p).toUri().toString()
        full.append(re.sub(r"\Afile:/+", "file:/", uri))  # as Spark's file metadata has it
    return {"paths": json.dumps(full), "rangebytes": str(range_bytes)}


def scan_lines(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All lines of the plain, gzip and zip files at ``paths`` as they are now, with ``reason`` for what could not be read.

    Paths are files or folders (one level, log names), may overlap and may be missing. A plain file is read in ranges of ``range_bytes``, a task each up to ``TASKS``, beyond that small ranges share tasks;
    a packed one is read by one task (:func:`logweave.plans.load.load_logs` splits those). ``line_id`` is the place of the line in the
    file, for gzip in the unpacked text, so reading again gives the same keys, and stitching with ``POSITION_BITS`` cuts chunks by bytes.
    ``base_date`` is the day of the file's modification in UTC. Of a damaged gzip file the text up to the damage is given.
    """
    return spark.read.format(NAME).options(**_options(spark, paths, range_bytes)).load()


def follow_lines(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Streaming twin of :func:`scan_lines`: lines that are added to the files, and files that are added to the folders.

    A line is given once its line feed is there, wherever looks cut it. A gzip file may grow by whole members, a zip file is read
    once, at first sight; write those under another name first and rename them. A file that became shorter is read anew, with a row
    whose ``reason`` says so and with keys that start again; one that was replaced by a longer one cannot be told from one that grew.
    The offset has a number per followed file, as Spark's own file streams keep theirs, and is planned on the driver; contents are not.
    A micro-batch takes all that was added, in ranges, so its size adds tasks and not memory.
    """
    return spark.readStream.format(NAME).options(**_options(spark, paths, range_bytes)).load()


def readable(lines: DataFrame) -> DataFrame:
    """The lines without the rows that only have a ``reason``."""
    return lines.filter("reason IS NULL").drop("reason")


def unreadable(lines: DataFrame) -> DataFrame:
    """(path, reason, bytes_read) of what could not be read."""
    return lines.filter("reason IS NOT NULL").selectExpr("source_path AS path", "reason", "line_id AS bytes_read")
