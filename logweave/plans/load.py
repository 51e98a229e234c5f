"""From paths to typed, grouped entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.fields import app_name, base_name
from logweave.operators.detect import HEAD_BYTES, detect_formats, heads_of, parse_detected
from logweave.operators.formats import LogFormat, default_formats
from logweave.operators.stitch import MAX_PART_BYTES
from logweave.schema import LINE_KEY
from logweave.session import attach, scratch_path, settle
from logweave.sources.archives import archive_lines, read_archives, rejected
from logweave.sources.files import head_text, is_binary, list_files, read_heads, read_lines, source_name
from logweave.sources.gzips import gzip_lines, gzip_rejects, index_members


class Loaded:
    """Result of a load: ``entries`` (parsed, with ``app``) and ``rejects`` (path, reason, bytes_read)."""

    def __init__(self, entries: DataFrame, rejects: DataFrame):
        self.entries = entries
        self.rejects = rejects


def load_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    formats: Sequence[LogFormat] | None = None,
    base_date=None,
    compat: bool = False,
    head_bytes: int = HEAD_BYTES,
    max_part_bytes: int = MAX_PART_BYTES,
) -> Loaded:
    """Load plain, gzip and zip logs: detect each file's format, parse, stitch and group by application.

    Folders are read one level deep for log names, missing paths are ignored, binary files give no entries.
    Paths may overlap; each file is read once. Detection reads the first ``head_bytes`` of each file (128 KiB; give more for
    files with long banners). What cannot be read ends up in ``rejects``, with the bytes of text that could be read before and
    behind the damage where they are known; that text is among the entries. A gzip file of many members is read by many
    tasks. Text of one entry above ``max_part_bytes`` goes on in further parts.
    """
    formats = list(formats if formats is not None else default_formats())
    files = settle(list_files(spark, paths))
    is_zip, is_7z = F.col("path").rlike(r"(?i)\.zip(?:\.gz)?\z"), F.col("path").rlike(r"(?i)\.7z\z")
    today = F.lit(base_date).cast("date") if base_date is not None else F.current_date()

    heads = settle(read_heads(files.filter(~is_zip & ~is_7z), head_bytes))
    is_gzip = F.col("path").rlike(r"(?i)\.gz\z") & ~is_zip
    members = index_members(files.filter(is_gzip).select("path", "length"))
    unread = heads.filter(F.col("reason").isNotNull() & ~F.col("source_path").rlike(r"(?i)\.gz\z"))
    unknown = F.lit(None).cast("long").alias("bytes_read")
    rejects = unread.select(F.col("source_path").alias("path"), "reason", unknown).unionByName(gzip_rejects(members))
    rejects = rejects.unionByName(files.filter(is_7z).select("path", F.lit("7z is not supported").alias("reason"), unknown))
    texts = heads.filter(F.octet_length("content") > 0).filter(~is_binary(F.col("content"), compat))
    texts = texts.select("source_path", head_text(F.col("content")).alias("head"))
    packed = gzip_lines(members).withColumnRenamed("path", "source_path")
    packed = attach(packed, files.select(F.col("path").alias("source_path"), source_name(F.col("name")).alias("source"), F.col("modified").cast("date").alias("base_date")), ["source_path"], "inner")
    lines = read_lines(spark, paths, gzip=False).unionByName(packed)
    if base_date is not None:
        lines = lines.withColumn("base_date", today)
    names = files.select(F.col("path").alias("source_path"), app_name(source_name(F.col("name"))).alias("app"))
    found = detect_formats(texts, formats, today).join(names, "source_path")
    entries = parse_detected(lines, formats, found, keep=("app",), max_part_bytes=max_part_bytes)

    if not files.filter(is_zip).isEmpty():
        archived = settle(read_archives(spark, paths))
        inner = archive_lines(archived).withColumn("base_date", today)
        texts = settle(heads_of(inner, head_bytes)).filter(~is_binary(F.col("head").cast("binary"), compat))
        names = inner.select("source_path", "source").distinct()
        names = names.select("source_path", app_name(base_name("source")).alias("app"))
        found = detect_formats(texts, formats, today).join(names, "source_path")
        entries = entries.unionByName(parse_detected(inner, formats, found, keep=("app",), max_part_bytes=max_part_bytes))
        rejects = rejects.unionByName(rejected(archived).withColumn("bytes_read", unknown))
    return Loaded(entries, rejects)


def store_entries(entries: DataFrame, path: str, sort: Sequence[str] = ("sort_ts", *LINE_KEY)) -> None:
    """Write entries once as Parquet by application, in time order inside each file.

    The range sort splits a large application over many files whose time ranges do not overlap, so a later
    time filter or as-of lookup skips most of them.
    """
    order = [c for c in sort if c in entries.columns]
    (
        entries.repartitionByRange("app", *order)
        .sortWithinPartitions("app", *order)
        .write.partitionBy("app")
        .mode("overwrite")
        .parquet(path)
    )


def stored(entries: DataFrame, name: str = "entries") -> DataFrame:
    """The entries written once as Parquet below the shared folder and read back.

    The interactive operators read their input several times; stored entries are parsed only once and are
    pruned by column and by row group.
    """
    path = scratch_path(entries.sparkSession, name)
    entries.write.parquet(path)
    return entries.sparkSession.read.parquet(path)
