"""Zip archives as lines, nested archives included."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.session import settle
from logweave.sources.files import LOG_ENDINGS, SKIPPED_ENDINGS, list_zips, locate

MEMBER_SCHEMA = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("line_id", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

BATCH_LINES = 10_000
BATCH_CHARS = 4 << 20
# Unpacked bytes of neighbouring members that are read in one go.
SLICE_BYTES = 64 << 20
_UNREADABLE = (OSError, EOFError, ValueError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError)


def _ending(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _text_lines(stream) -> Iterator[str]:
    for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None):
        yield line.removesuffix("\n")


def _places(archive: zipfile.ZipFile) -> list[tuple[zipfile.ZipInfo, str]]:
    """The files in a zip archive, each with its place: the name, and a number where the name was there before."""
    seen: Counter[str] = Counter()
    out = []
    for info in archive.infolist():
        if not info.is_dir():
            seen[info.filename] += 1
            again = seen[info.filename]
            out.append((info, info.filename + (f"#{again}" if again > 1 else "")))
    return out


def _member(archive: zipfile.ZipFile, info: zipfile.ZipInfo, place: str) -> Iterator[tuple[str, str, object]]:
    """What :func:`_members` gives, for one file in an archive."""
    name = info.filename
    if _ending(name) == "7z":
        yield place, name, None
    elif _ending(name) in ("zip", "gz"):
        with archive.open(info) as stream:
            yield from _members(name, stream, f"{place}!")
    elif _ending(name) not in SKIPPED_ENDINGS:
        with archive.open(info) as stream:
            yield place, name, stream


def _members(name: str, stream, where: str = "") -> Iterator[tuple[str, str, object]]:
    """(place, source name, byte stream) of every readable text member, depth first; no stream for an inner 7z archive.

    ``place`` tells members of equal name apart, by the inner archive and, within one, by a number.
    """
    kind = _ending(name)
    if kind == "zip":
        seekable = stream if stream.seekable() else io.BytesIO(stream.read())
        with zipfile.ZipFile(seekable) as archive:
            for info, place in _places(archive):
                yield from _member(archive, info, f"{where}{place}")
    elif kind == "gz":
        inner = name[:-3]
        with gzip.GzipFile(fileobj=stream) as unpacked:
            if _ending(inner) in ("zip", "gz"):
                yield from _members(inner, unpacked, where)
            else:
                label = inner if _ending(inner) in LOG_ENDINGS else name
                yield where or name, label, unpacked
    else:
        yield where or name, name, stream


def _member_rows(path: str, members: Iterator[tuple[str, str, object]]) -> Iterator[tuple]:
    """Lines of members of the archive ``path``, as rows."""
    line_id = 0
    try:
        for place, member, text in members:
            if text is None:
                yield f"{path}!{place}", None, line_id, None, "7z is not supported"
                continue
            for line in _text_lines(text):
                yield f"{path}!{place}", member, line_id, line, None
                line_id += 1
    except _UNREADABLE as e:
        yield path, None, line_id, None, f"{type(e).__name__}: {e}"


def _framed(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows in batches of at most ``BATCH_LINES`` lines and about ``BATCH_CHARS`` characters, whatever archives they are from."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[3] or "")
        if len(held) >= BATCH_LINES or size >= BATCH_CHARS:
            yield pd.DataFrame(held, columns=MEMBER_SCHEMA.names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=MEMBER_SCHEMA.names)


def _member_lines(path: str, members: Iterator[tuple[str, str, object]]) -> Iterator[pd.DataFrame]:
    """Line batches of members of the archive ``path``."""
    return _framed(_member_rows(path, members))


def explode_archives(archives: DataFrame) -> DataFrame:
    """Lines of archives given as (path, content): (archive, member, line_id, value, reason).

    Every member becomes a source named by its path in the archive; zip and gzip members are opened at any
    depth; members with binary endings are skipped. An unreadable archive gives one row with a ``reason``,
    after the lines that could still be read. For archives in files see :func:`read_archives`.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archived = ((path, content) for batch in batches for path, content in zip(batch["path"], batch["content"]))
        return _framed(row for path, content in archived for row in _member_rows(path, _members(path, io.BytesIO(content))))

    return archives.select("path", "content").mapInPandas(explode, MEMBER_SCHEMA)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with up to ``SLICE_BYTES`` together, or one."""
    low, total = 0, 0
    for k, size in enumerate(sizes):
        if k > low and total + size > SLICE_BYTES:
            yield low, k
            low, total = k, 0
        total += size
    if sizes:
        yield low, len(sizes)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of the top-level members of zip files, with their unpacked bytes; a gzipped zip is one slice without range."""
    for batch in batches:
        for path in batch["path"]:
            try:
                if _ending(path) != "zip":
                    rows = [(path, None, None, SLICE_BYTES, None)]
                else:
                    fs, inner = locate(path)
                    with fs.open_input_file(inner) as f, zipfile.ZipFile(f) as archive:
                        sizes = [info.file_size for info, _ in _places(archive)]
                    rows = [(path, low, high, sum(sizes[low:high]), None) for low, high in _slices(sizes)]
            except _UNREADABLE as e:
                rows = [(path, None, None, 0, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=["path", "low", "high", "bytes", "reason"]).astype(dict.fromkeys(("low", "high", "bytes"), "Int64"))


def _read_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of each slice; the archive is opened once for it, and a damaged member does not end it."""
    for batch in batches:
        for path, low, high in zip(batch["path"], batch["low"], batch["high"]):
            try:
                fs, inner = locate(path)
                with fs.open_input_file(inner) as stream:
                    if pd.isna(low):
                        yield from _member_lines(path, _members(path, stream))
                    else:
                        with zipfile.ZipFile(stream) as archive:
                            for info, place in _places(archive)[int(low) : int(high)]:
                                yield from _member_lines(path, _member(archive, info, place))
            except _UNREADABLE as e:
                yield pd.DataFrame([(path, None, 0, None, f"{type(e).__name__}: {e}")], columns=MEMBER_SCHEMA.names)


def read_archives(spark: SparkSession, paths) -> DataFrame:
    """Exploded lines of the zip files at ``paths`` (files or folders), as :func:`explode_archives` gives them.

    The members are listed first and then read in slices of about ``SLICE_BYTES``, so one archive with many members is
    read by many tasks, and there are more tasks where there is more to unpack. Files are streamed, not loaded.
    """
    cores = spark.sparkContext.defaultParallelism
    listed = list_zips(spark, paths).repartition(cores, "path").mapInPandas(
        _entries, "path string, low long, high long, bytes long, reason string"
    )
    listed = settle(listed)
    damaged = listed.filter(F.col("reason").isNotNull()).select(
        F.col("path").alias("archive"), F.lit(None).cast("string").alias("member"), F.lit(0).cast("long").alias("line_id"),
        F.lit(None).cast("string").alias("value"), "reason",
    )
    total = listed.agg(F.sum("bytes")).first()[0] or 0
    parts = max(cores, -(-total // SLICE_BYTES))
    readable = listed.filter(F.col("reason").isNull()).select("path", "low", "high").repartition(parts, "path", "low")
    return readable.mapInPandas(_read_entries, MEMBER_SCHEMA).unionByName(damaged)


def archive_lines(exploded: DataFrame) -> DataFrame:
    """Exploded members as lines with a line key."""
    return exploded.filter(F.col("reason").isNull()).select(
        F.col("archive").alias("source_path"),
        F.col("member").alias("source"),
        F.lit(0).cast("long").alias("block_start"),
        "line_id",
        "value",
    )


def rejected(exploded: DataFrame) -> DataFrame:
    """Archives that could not be read to the end: (path, reason)."""
    return exploded.filter(F.col("reason").isNotNull()).select(F.col("archive").alias("path"), "reason")
