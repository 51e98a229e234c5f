"""Summaries of loaded logs: applications, column presence and load metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logweave.functions.fields import app_name, base_name, is_meaningful, severity, view_title
from logweave.session import attach, settle


def with_app(df: DataFrame) -> DataFrame:
    """Add ``app``, the application of each source, to lines or entries.

    Names are stripped once per distinct source. Apply it to stored entries, or to lines before they are
    parsed, so that finding the names costs only a scan.
    """
    names = df.select("source").distinct()
    apps = settle(names.withColumn("app", app_name(base_name("source"))))
    return attach(df, apps, ["source"], "left")


def entry_once(entries: DataFrame) -> Column:
    """True in one row per entry: large entries go on in further parts."""
    return F.col("part") == 0 if "part" in entries.columns else F.lit(True)


def by_application(entries: DataFrame) -> DataFrame:
    """Entries, distinct files, errors, time span and title per application."""
    once = entry_once(entries)
    return (
        entries.groupBy("app")
        .agg(
            F.count_if(once).alias("entries"),
            F.count_distinct(base_name("source")).alias("files"),
            F.count_if(once & (severity("level") == "error")).alias("errors"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
        .withColumn("title", view_title("app", sources="files"))
    )


def column_presence(entries: DataFrame, by: str = "view") -> DataFrame:
    """Per view, which columns hold anything; ``source`` counts only with more than one distinct source."""
    any_of = [F.max(is_meaningful(c)).alias(c) for c in ("level", "thread", "logger", "ip")]
    sources = F.count_distinct(F.when(is_meaningful("source"), F.col("source")))
    return entries.groupBy(by).agg(
        F.max(F.col("timestamp").isNotNull()).alias("timestamp"), *any_of, (sources > 1).alias("source")
    )


def presence_of(entries: DataFrame, view: str, by: str = "view") -> dict[str, bool]:
    """:func:`column_presence` of one view as a dict, for :func:`logweave.functions.fields.visible_columns`."""
    row = column_presence(entries.filter(F.col(by) == view), by).first()
    return {k: v for k, v in row.asDict().items() if k != by} if row else {}


def source_count(by: str | None = None) -> Column:
    """Aggregate: number of distinct sources, null counting as one more."""
    return F.count_distinct("source") + F.max(F.col("source").isNull().cast("int")).cast("long")


def observed(entries: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """The entries, plus an observation that holds their number and errors once they have been written."""
    seen, once = Observation(name), entry_once(entries)
    watched = entries.observe(
        seen,
        F.count_if(once).alias("entries"),
        F.count_if(once & F.col("timestamp").isNotNull()).alias("timed"),
        F.count_if(once & (severity("level") == "error")).alias("errors"),
    )
    return watched, seen
