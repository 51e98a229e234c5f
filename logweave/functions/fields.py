"""Derived columns of a log entry. Every function takes and returns Columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.schema import REMOTE_APP

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
# Characters up to the blank, which are stripped around names.
BLANK_CHARS = "".join(map(chr, range(0x21)))
# Entry columns that can be shown, in display order.
DISPLAY = ("timestamp", "level", "thread", "logger", "ip", "message", "source")


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def short_logger(logger) -> Column:
    """Last segment of a logger name; ``Tag.java:105`` counts as ``Tag:105``."""
    return F.coalesce(F.substring_index(F.replace(_c(logger), F.lit(".java:"), F.lit(":")), ".", -1), F.lit(""))


def short_thread(thread) -> Column:
    """Thread name up to the first parenthesis, last segment of it."""
    return F.coalesce(F.substring_index(F.substring_index(_c(thread), "(", 1), ".", -1), F.lit(""))


def full_time_text(timestamp) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` of a wall-clock time, whatever the session time zone."""
    text = _c(timestamp).cast("timestamp_ntz").cast("string")
    return F.rpad(F.when(F.length(text) == 19, F.concat(text, F.lit("."))).otherwise(text), 23, "0")


def clock_text(timestamp) -> Column:
    """``HH:mm:ss.SSS``, empty without a time."""
    return F.coalesce(F.substr(full_time_text(timestamp), F.lit(12)), F.lit(""))


def detail_fields(df: DataFrame) -> Column:
    """Map of the non-empty fields of an entry (Time, Level, Thread, Logger, IP, Source)."""
    pairs = {
        "Time": full_time_text("timestamp"),
        "Level": F.col("level"),
        "Thread": F.col("thread"),
        "Logger": F.col("logger"),
        "IP": F.col("ip"),
        "Source": F.col("source"),
    }
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull() & (v != ""))


def base_name(path) -> Column:
    """File name of a source path."""
    return F.substring_index(_c(path), "/", -1)


# Endings that are stripped from a file name, in this order, until nothing changes.
NAME_ENDINGS = (
    re.compile(r"\.(gz|zip|7z|log|txt|bak|old|tmp)\Z", re.I),
    re.compile(r"\.[0-9]+\Z"),
    re.compile(r"[-_.]?[0-9]{4}[-_.]?[0-9]{2}[-_.]?[0-9]{2}\Z"),
    re.compile(r"[-_.]?[vV]?[0-9]+(\.[0-9]+)*\Z"),
)


def strip_name(name: str) -> str:
    """Application name of one file name."""
    left, before = name, None
    while left != before:
        before = left
        for ending in NAME_ENDINGS:
            left = ending.sub("", left)
    return re.sub(r"[-_.]+\Z", "", left) or name


@F.pandas_udf(T.StringType())
def _app_names(names: pd.Series) -> pd.Series:
    known = {n: strip_name(n) for n in names.dropna().unique()}
    return names.map(known)


def app_name(source) -> Column:
    """Application name from a file name, as an Arrow-batched UDF. Apply it to distinct names."""
    return _app_names(_c(source))


def workload_name(pod) -> Column:
    """Pod name without its replica hash or index."""
    # Fixed value: the ending that a deployment or a stateful set gives its pods.
    return F.coalesce(F.regexp_replace(_c(pod), r"-(?:[a-z0-9]{8,15}-[a-z0-9]{5}|[0-9]+)$", ""), F.lit(""))


def safe_file_name(title) -> Column:
    return F.regexp_replace(_c(title), r"[^a-zA-Z0-9._\-]", "_")


def severity(level) -> Column:
    """``warn``, ``error`` or ``normal``."""
    upper = F.upper(_c(level))
    return (
        F.when(F.contains(upper, F.lit("WARN")), "warn")
        .when(F.contains(upper, F.lit("ERROR")) | F.contains(upper, F.lit("FATAL")), "error")
        .otherwise("normal")
    )


def is_meaningful(value) -> Column:
    """False for null, blank and ``UNKNOWN`` in any case."""
    text = F.btrim(_c(value), F.lit(BLANK_CHARS))
    return F.coalesce((text != "") & (F.upper(text) != "UNKNOWN"), F.lit(False))


def view_title(app, ip=None, port=None, sources=None) -> Column:
    """Title of a view: ``app``, ``app (ip)`` or ``Remote(ip:port)``; ``(Auto-Merged)`` for more than one file."""
    app = _c(app)
    title = app
    if ip is not None:
        ip = _c(ip)
        remote = F.concat(F.lit("Remote("), ip, F.lit(":"), _c(port).cast("string"), F.lit(")"))
        title = F.when(app == REMOTE_APP, remote).otherwise(F.concat(app, F.lit(" ("), ip, F.lit(")")))
    if sources is not None:
        title = F.when(_c(sources) > 1, F.concat(title, F.lit(" (Auto-Merged)"))).otherwise(title)
    return title


def level_rank(level) -> Column:
    """Position of a level in DEBUG < INFO < WARN < ERROR; anything else counts as DEBUG."""
    upper = F.upper(_c(level))
    rank = F.when(upper == LEVELS[1], 1).when(upper == LEVELS[2], 2).when(upper == LEVELS[3], 3)
    return F.coalesce(rank, F.lit(0))


def from_epoch_millis(millis, zone: str = "UTC") -> Column:
    """Wall-clock time in ``zone`` of an epoch in milliseconds."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (_c(millis).cast("long") / F.lit(1000)).cast("decimal(20,6)")
    utc = epoch + F.make_dt_interval(secs=seconds)
    if zone in ("UTC", "Etc/UTC"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def visible_columns(df: DataFrame, profile: dict[str, bool], wanted: dict[str, bool] | None = None) -> DataFrame:
    """Only the display columns the user wants, minus those that ``profile`` proves empty."""
    wanted = wanted or {}
    return df.select([c for c in DISPLAY if profile.get(c, True) and wanted.get(c, True)])
