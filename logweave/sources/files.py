"""Text files as lines: plain and gzip files, folders, binary rejection, file heads."""

from __future__ import annotations

import glob
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings that a folder scan picks up, and endings of archive members that hold no log text.
LOG_ENDINGS = ("log", "txt", "zip", "7z", "gz")
SKIPPED_ENDINGS = (
    "class", "jar", "exe", "dll", "so", "png", "jpg", "jpeg", "gif", "pdf", "zip", "7z", "gz", "tar", "iso",
)
# Binary test on the first bytes of a file.
BINARY_SAMPLE = 1024
BINARY_SHARE = 0.3


def is_log_name(name) -> Column:
    """Name that a folder scan picks up."""
    return F.lower(F.col(name) if isinstance(name, str) else name).rlike(r"\.(?:" + "|".join(LOG_ENDINGS) + r")\z")


def is_skipped_name(name) -> Column:
    """Archive member that is not read as text (archives among them are opened instead)."""
    return F.lower(F.col(name) if isinstance(name, str) else name).rlike(r"\.(?:" + "|".join(SKIPPED_ENDINGS) + r")\z")


def source_name(name: Column) -> Column:
    """Display name of a file, without ``.gz`` if a log name is left."""
    inner = F.regexp_replace(name, r"(?i)\.gz\z", "")
    return F.when(name.rlike(r"(?i)\.gz\z") & is_log_name(inner), inner).otherwise(name)


def is_binary(content: Column, compat: bool = False) -> Column:
    """Whether the start of a file looks binary: any NUL, or more than 30 % control bytes.

    With ``compat`` bytes above 127 count as control bytes too, and the share is taken of all ``content``
    (of the detection head) instead of the sample, as older tools do.
    """
    sample = F.substr(content, F.lit(1), F.lit(BINARY_SAMPLE))
    # one character per byte, so that a text function can count bytes
    text = F.decode(sample, "ISO-8859-1")
    control = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F" + (r"\x80-\xFF]" if compat else "]")
    nul = F.regexp_count(text, F.lit(r"\x00")) > 0
    size = F.octet_length(content if compat else sample)
    return F.coalesce(nul | (F.regexp_count(text, F.lit(control)) > F.lit(BINARY_SHARE) * size), F.lit(False))


# Lines of files: the line key, the text and the day that stamps without a date get.
LINES = "source_path string, source string, block_start bigint, line_id bigint, value string, base_date date"

# Folder scans list these names only, so other files are never opened.
_TEXT_GLOB = "*.{[lL][oO][gG],[tT][xX][tT],[gG][zZ]}"


_TEXT_NAME = re.compile(r"[^._].*\.(?:log|txt|gz)", re.IGNORECASE)


def split_paths(spark: SparkSession, paths: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """(files, folders) among ``paths``, each once; missing ones are left out.

    A file that the scan of a given folder reads anyway is left out too, so no file is scanned twice.
    """
    files, folders = {}, {}
    for path in [paths] if isinstance(paths, str) else paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            full = fs.makeQualified(p)
            found = folders if fs.getFileStatus(p).isDirectory() else files
            found[full.toString()] = (str(full.getParent()), full.getName())
    apart = [f for f, (parent, name) in files.items() if parent not in folders or not _TEXT_NAME.fullmatch(name)]
    return apart, list(folders)


def plain_name(name: Column) -> Column:
    """A file name from the file metadata, which has it percent-encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _scan(spark: SparkSession, fmt: str, files: list[str], folders: list[str], name_glob: str) -> list[DataFrame]:
    """One scan of the named files, one of the folders (one level, matching names)."""
    reader = lambda: spark.read.format(fmt).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    scans = [reader().load([glob.escape(f) for f in files])] if files else []
    if folders:
        scans.append(reader().option("pathGlobFilter", name_glob).load([glob.escape(d) for d in folders]))
    return scans


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, name, length, modified) of the given files and of the log files in the given folders.

    Folders are read one level deep and only for log names; files named outright are taken whatever their
    name. Empty files are left out. Only the listing is read, no content.
    """
    scans = _scan(spark, "binaryFile", *split_paths(spark, paths), "*")
    if not scans:
        return spark.createDataFrame([], "path string, name string, length bigint, modified timestamp")
    listed = [
        s.select(
            F.col("_metadata.file_path").alias("path"),
            plain_name(F.col("_metadata.file_name")).alias("name"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
        for s in scans
    ]
    if split_paths(spark, paths)[1]:
        listed[-1] = listed[-1].filter(is_log_name("name"))
    return _all(listed).distinct()


def read_lines(spark: SparkSession, paths: str | Sequence[str], gzip: bool = True) -> DataFrame:
    """Lines of plain and gzip text files with their line key.

    Folders are read one level deep for ``.log``, ``.txt`` and ``.gz`` names; files named outright are taken
    whatever their name. Zip archives are read by :func:`logweave.sources.archives.read_archives`. Large
    plain files are split over many tasks, a gzip file is read by one and dropped at damage; without ``gzip`` it is left
    out, for :func:`logweave.sources.gzips.gzip_lines`, which splits it and keeps what can be read.
    """
    files, folders = split_paths(spark, paths)
    # Archives are left out by name, so Spark drops them from the listing and never opens them as text.
    other = r"(?i)\.(?:zip(?:\.gz)?|7z)\z" if gzip else r"(?i)\.(?:zip|gz|7z)\z"
    text = ~F.col("_metadata.file_name").rlike(other)
    scans = [s.filter(text) for s in _scan(spark, "text", files, folders, _TEXT_GLOB)]
    if not scans:
        return spark.createDataFrame([], LINES)
    return _all(
        [
            s.select(
                F.col("_metadata.file_path").alias("source_path"),
                source_name(plain_name(F.col("_metadata.file_name"))).alias("source"),
                F.col("_metadata.file_block_start").alias("block_start"),
                F.monotonically_increasing_id().alias("line_id"),
                "value",
                F.col("_metadata.file_modification_time").cast("date").alias("base_date"),
            )
            for s in scans
        ]
    )


def list_zips(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path) of the zip archives among ``paths``; only the listing is read."""
    return list_files(spark, paths).filter(F.col("name").rlike(r"(?i)\.zip(?:\.gz)?\z")).select("path")


HEADS_SCHEMA = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("reason", T.StringType()),
    ]
)


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path, for reading a file inside a task."""
    if ":" not in path:
        path = f"file://{os.path.abspath(path)}"
    # Spark leaves letters outside ASCII as they are; a URI has them percent-encoded.
    path = "".join(c if c.isascii() else quote(c) for c in path)
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _first_bytes(path: str, n: int) -> tuple[bytes, str | None]:
    """The first ``n`` bytes, unpacked, and why there are no more of a damaged file."""
    fs, inner = locate(path)
    with fs.open_input_stream(inner, compression=None) as stream:
        if not path.lower().endswith(".gz"):
            return stream.read(n), None
        gunzip, out, packed = zlib.decompressobj(wbits=31), b"", b""
        try:
            while len(out) < n:
                packed = packed or stream.read(4096)
                if not packed:
                    if not gunzip.eof:
                        raise EOFError("the file ends inside its compressed data")
                    break
                if gunzip.eof:  # the next member of a concatenated file
                    gunzip = zlib.decompressobj(wbits=31)
                out += gunzip.decompress(packed, n - len(out))
                packed = gunzip.unconsumed_tail or gunzip.unused_data
        except (EOFError, zlib.error) as e:
            return out, f"{type(e).__name__}: {e}"
        return out, None


def read_heads(files: DataFrame, head_bytes: int = 128 * 1024) -> DataFrame:
    """First bytes of each listed file: (source_path, content, reason); ``reason`` tells why none could be read.

    Reads ``head_bytes`` per file, never the whole file; gzip files are unpacked as far as needed, and of a file that is
    damaged within its head the readable part is given. The executors must be able to open the paths.
    """

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    content, reason = _first_bytes(path, head_bytes)
                except (OSError, EOFError, zlib.error, ValueError) as e:
                    content, reason = None, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"source_path": [path], "content": [content], "reason": [reason]})

    spread = files.select("path").repartition("path")
    return spread.mapInPandas(heads, HEADS_SCHEMA)


def head_text(content: Column) -> Column:
    """Bytes as text, torn or invalid sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))
