"""Queries for the whole load: files on disk to typed, grouped entries. The files hold the driver's events as log text."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.fields import app_name
from logweave.operators.detect import parse_detected
from logweave.operators.formats import default_formats
from logweave.plans import rendering as r
from logweave.plans.load import load_logs
from logweave.plans.queries import EVENTS, LINES, query
from logweave.session import scratch_path, settle
from logweave.sources import followed
from logweave.sources.files import locate
from logweave.streaming import live

# A blank, a percent sign and a plus in every file name.
PREFIX = "a b%20+"


def _folder(spark: SparkSession) -> str:
    path = scratch_path(spark, "files")
    return path if ":" in path else f"file://{path}"


def _render(spark: SparkSession, sf_dir: str, folder: str, pack) -> list[str]:
    """Write a file per source of the events; ``pack(name, text)`` gives (file name, bytes). Returns the names."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("event_id")
        name, content = pack(group["source"].iloc[0], "\n".join(group["value"]) + "\n")
        fs, root = locate(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(content)
        return pd.DataFrame({"name": [name]})

    lines = r.event_lines(spark, sf_dir).select("source", "event_id", "value")
    return [row.name for row in lines.groupBy("source").applyInPandas(write, "name string").collect()]


def _entries(loaded) -> DataFrame:
    return loaded.entries.select("app", "source", "timestamp", "level", "thread", "logger", "message")


def _sql(source: str, app: str = f"'{PREFIX}' || event_type") -> str:
    return f"""WITH {EVENTS} SELECT {app} AS app, {source} AS source, ts_ms AS timestamp, lvl AS level, thr AS thread,
               log AS logger, msg AS message FROM ev"""


@query("load_folder", _sql(f"'{PREFIX}' || source"))
def load_folder(spark, sf_dir):
    folder = _folder(spark)
    _render(spark, sf_dir, folder, lambda name, text: (PREFIX + name, text.encode()))
    return _entries(load_logs(spark, folder))


@query("load_overlapping_paths", _sql("source", "event_type"))
def load_overlapping_paths(spark, sf_dir):
    folder = _folder(spark)
    names = _render(spark, sf_dir, folder, lambda name, text: (name, text.encode()))
    return _entries(load_logs(spark, [folder, f"{folder}/{min(names)}", f"{folder}/", f"{folder}/{min(names)}"]))


@query("load_gzip", _sql(f"'{PREFIX}' || source"))
def load_gzip(spark, sf_dir):
    folder = _folder(spark)
    _render(spark, sf_dir, folder, lambda name, text: (f"{PREFIX}{name}.gz", gzip.compress(text.encode())))
    return _entries(load_logs(spark, folder))


def _zip_pack(name: str, text: str) -> tuple[str, bytes]:
    """The same text twice under one name, once in an inner zip; beside it an inner 7z archive."""
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr(f"deep/{name}", text)
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr(name, text)
        z.writestr(zipfile.ZipInfo(name), text)
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("old.7z", b"7z\xbc\xaf'\x1c")
    return f"{PREFIX}{name}.zip", outer.getvalue()


@query(
    "load_zip",
    f"""WITH {EVENTS} SELECT event_type AS app, unnest([source, source, 'deep/' || source]) AS source, ts_ms AS timestamp,
        lvl AS level, thr AS thread, log AS logger, msg AS message FROM ev""",
)
def load_zip(spark, sf_dir):
    folder = _folder(spark)
    _render(spark, sf_dir, folder, _zip_pack)
    return _entries(load_logs(spark, folder))


@query(
    "load_rejects",
    f"""WITH {EVENTS}, s AS (SELECT DISTINCT source FROM ev)
        SELECT '{PREFIX}' || source || '.zip!old.7z' AS name, '7z is not supported' AS reason FROM s""",
)
def load_rejects(spark, sf_dir):
    folder = _folder(spark)
    _render(spark, sf_dir, folder, _zip_pack)
    rejects = load_logs(spark, folder).rejects
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return rejects.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), "reason")


def _members(text: str) -> list[bytes]:
    """The text in gzip members of 700 characters, cut wherever that is."""
    data = text.encode()
    return [gzip.compress(data[k : k + 700], mtime=0) for k in range(0, len(data), 700)]


@query("load_gzip_members", _sql(f"'{PREFIX}' || source"))
def load_gzip_members(spark, sf_dir):
    """Files of many members, whose borders cut lines."""
    folder = _folder(spark)
    _render(spark, sf_dir, folder, lambda name, text: (f"{PREFIX}{name}.gz", b"".join(_members(text))))
    return _entries(load_logs(spark, folder))


@query("load_damaged_gzip", _sql("source", "event_type"))
def load_damaged_gzip(spark, sf_dir):
    """Before the last member of each file stands one that is nothing but its header: all text is read nevertheless."""
    folder = _folder(spark)

    def pack(name: str, text: str) -> tuple[str, bytes]:
        head, _, last = text[:-1].rpartition("\n")
        parts = [gzip.compress(f"{head}\n".encode()) if head else b"", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03", gzip.compress(f"{last}\n".encode())]
        return f"{name}.gz", b"".join(parts)

    _render(spark, sf_dir, folder, pack)
    return _entries(load_logs(spark, folder))


@query(
    "load_damaged_gzip_rejects",
    f"""WITH {LINES} SELECT source || '.gz' AS name, sum(strlen(line) + 1)::BIGINT AS bytes_read FROM ln GROUP BY source""",
)
def load_damaged_gzip_rejects(spark, sf_dir):
    folder = _folder(spark)

    def pack(name: str, text: str) -> tuple[str, bytes]:
        return f"{name}.gz", gzip.compress(text.encode()) + b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03"

    _render(spark, sf_dir, folder, pack)
    return load_logs(spark, folder).rejects.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "bytes_read")


@query("load_planned_ranges", _sql(f"'{PREFIX}' || source"))
def load_planned_ranges(spark, sf_dir):
    """The planned source in ranges of 64 KiB, its lines stitched in chunks of bytes."""
    folder = _folder(spark)
    _render(spark, sf_dir, folder, lambda name, text: (PREFIX + name, text.encode()))
    lines = settle(followed.readable(followed.scan_lines(spark, folder, 1 << 16)))
    return _followed_entries(lines)


def _followed_entries(lines: DataFrame) -> DataFrame:
    entries = parse_detected(lines, default_formats(), keep=("source",), chunk_bits=followed.POSITION_BITS)
    app = app_name(F.col("source")).alias("app")
    return entries.select(app, "source", "timestamp", "level", "thread", "logger", "message")


# Looks at the growing folder of the next query.
LOOKS = 3


@query("load_followed_folder", _sql(f"'{PREFIX}' || source"))
def load_followed_folder(spark, sf_dir):
    """Every file grows in pieces that end inside lines; between them a stream takes what is there, from its checkpoint each time."""
    folder, landed, offsets = _folder(spark), scratch_path(spark, "landed"), scratch_path(spark, "landed-offsets")

    def upto(look: int):
        return lambda name, text: (PREFIX + name, text.encode()[: len(text.encode()) * look // LOOKS])

    for look in range(1, LOOKS + 1):
        _render(spark, sf_dir, folder, upto(look))
        live.append_to(followed.follow_lines(spark, folder, 1 << 16), landed, offsets, available_now=True).awaitTermination()
    return _followed_entries(followed.readable(spark.read.parquet(landed)))
