"""Views in time: chronological order, merging, time synchronisation and view lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.predicates import has_times
from logweave.operators.ordered import ceiling_lookup, wall_seconds
from logweave.operators.profile import entry_once
from logweave.operators.stitch import CHUNK_BITS
from logweave.schema import REMOTE_APP, entry_key
from logweave.session import attach, settle

MERGED_VIEW = "Merged View"
# Views of a table that meet the anchors at once.
VIEW_BLOCK = 1000
ORDER = ("sort_ts", "source_path", "block_start", "line_id", "part")


def with_sort_time(entries: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Add ``sort_ts``: the entry's time, or for an untimed entry the next time of its source, else the last.

    Timed entries pass straight through. Only the untimed ones, usually one header per source, are looked up.
    """
    bucket = F.struct(F.col("block_start"), F.shiftright(F.col("line_id"), chunk_bits).alias("chunk"))
    placed = entries.withColumn("pos", entry_key())
    timed = F.col("timestamp").isNotNull()
    points = placed.filter(timed).select("source_path", bucket.alias("bucket"), "pos", F.col("timestamp").alias("hit"))
    untimed = placed.filter(~timed)
    queries = untimed.select("source_path", bucket.alias("bucket"), "pos")
    found = ceiling_lookup(points, queries, ["source_path"]).select("source_path", "pos", F.col("hit").alias("sort_ts"))
    resolved = untimed.join(found, ["source_path", "pos"], "left").drop("pos")
    return entries.filter(timed).withColumn("sort_ts", F.col("timestamp")).unionByName(resolved)


def chronological(entries: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Entries in time order, entries of equal time in source order; a range-partitioned sort."""
    return entries.orderBy(*[c for c in order if c in entries.columns])


def merge_views(entries: DataFrame, views: Sequence[str], title: str = MERGED_VIEW) -> DataFrame:
    """All entries of ``views`` as one view; ``origin_view`` keeps where they came from.

    Refused if one of the views has no timed entry at all.
    """
    if not views:
        raise ValueError("no views selected")
    chosen = entries.filter(F.col("view").isin(*views))
    untimed = sorted(r["view"] for r in has_times(chosen).filter(~F.col("timed")).collect())
    if untimed:
        raise ValueError(f"cannot merge views without time stamps: {untimed}")
    return chosen.withColumn("origin_view", F.col("view")).withColumn("view", F.lit(title))


def unmerge(merged: DataFrame, origin_view: str) -> DataFrame:
    """The entries that ``origin_view`` brought into a merged view, under their old name."""
    back = merged.filter(F.col("origin_view") == origin_view)
    return back.withColumn("view", F.col("origin_view")).drop("origin_view")


def sync_to(entries: DataFrame, anchor, source_view: str | None = None, key: str = "entry_key") -> DataFrame:
    """Per view, the first entry at or after one time, or the last entry: (view, timestamp, key, clamped)."""
    at = F.lit(anchor).cast("timestamp_ntz")
    timed = entries.filter(F.col("timestamp").isNotNull())
    if source_view is not None:
        timed = timed.filter(F.col("view") != source_view)
    row = F.struct("timestamp", key)
    found = timed.groupBy("view").agg(
        F.min(F.when(F.col("timestamp") >= at, row)).alias("next"), F.max(row).alias("final")
    )
    hit = F.coalesce("next", "final")
    return found.select(
        "view", hit["timestamp"].alias("timestamp"), hit[key].alias(key), F.col("next").isNull().alias("clamped")
    )


def _targets(anchors: DataFrame, views: Sequence[str] | DataFrame) -> DataFrame:
    """Each anchor with every view that it moves: (anchor_id, anchor_view, timestamp, view), never its own view."""
    asked = anchors.select("anchor_id", F.col("view").alias("anchor_view"), "timestamp")
    if not isinstance(views, DataFrame):
        met = asked.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views]).cast("array<string>")))
    elif "anchor_view" in views.columns:
        met = attach(asked, settle(views.select("anchor_view", "view").distinct()), ["anchor_view"], "inner")
    else:
        # All pairs are the result asked for; the views meet the anchors in blocks, by an equal join.
        names = settle(views.select("view").filter(F.col("view").isNotNull()).distinct())
        blocks = names.count() // VIEW_BLOCK + 1
        names = names.withColumn("_block", F.pmod(F.xxhash64("view"), F.lit(blocks)).cast("int"))
        everywhere = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = attach(everywhere, names, ["_block"], "inner").drop("_block")
    return met.filter(F.col("view") != F.col("anchor_view"))


def sync_views(
    entries: DataFrame,
    anchors: DataFrame,
    views: Sequence[str] | DataFrame | None = None,
    key: str = "entry_key",
    visible: Column | None = None,
    bucket_seconds: int = 60,
) -> DataFrame:
    """As-of join: each anchor time moves every other view to its first entry at or after it, else its last.

    ``entries`` has view, timestamp and an orderable ``key``; ``anchors`` has anchor_id, view and timestamp.
    The result has one row per anchor and other view: anchor_id, anchor_ts, view, timestamp, key, clamped,
    and ``visible`` (whether the target passes that filter). An anchor without time matches nothing.

    ``views`` says which views are moved: a short list of names, a table with ``view``, a table of links with
    ``anchor_view`` and ``view`` (an anchor then moves only the views linked to its own), or by default all views of
    ``entries``. Tables may have any number of views; nothing of them goes through the driver or into the plan.
    """
    shown = F.coalesce(visible, F.lit(False)) if visible is not None else F.lit(True)
    bucket = F.floor(wall_seconds("timestamp") / F.lit(bucket_seconds))
    points = entries.filter(F.col("timestamp").isNotNull()).select(
        "view",
        bucket.alias("bucket"),
        F.col("timestamp").alias("pos"),
        F.struct(F.col(key).alias("key"), F.col("timestamp"), shown.alias("visible")).alias("hit"),
    )
    targets = _targets(anchors, views if views is not None else entries.select("view")).withColumn("pos", F.col("timestamp"))
    queries = targets.filter(F.col("pos").isNotNull()).select("view", bucket.alias("bucket"), "pos")
    found = ceiling_lookup(points, queries, ["view"])
    return targets.join(found, ["view", "pos"], "left").select(
        "anchor_id",
        F.col("pos").alias("anchor_ts"),
        "view",
        F.col("hit.timestamp").alias("timestamp"),
        F.col("hit.key").alias(key),
        "clamped",
        F.col("hit.visible").alias("visible"),
    )


def anchors_from(entries: DataFrame, chosen: Column, key: str = "entry_key") -> DataFrame:
    """Anchors for :func:`sync_views` from chosen rows: their view, key and time."""
    return entries.filter(chosen).select(F.col(key).alias("anchor_id"), "view", "timestamp")


def view_port(app="app", port="port") -> Column:
    """The port counts for the identity of a view only if the application is unnamed."""
    return F.when(F.col(app) == REMOTE_APP, F.col(port)).otherwise(F.lit(-1))


def find_views(events: DataFrame, views: DataFrame) -> DataFrame:
    """Add ``view``: the first view with the event's app and ip, and port for unnamed apps; else null.

    ``views`` has view, position, app, ip and port.
    """
    keys = ["app", "ip", "view_port"]
    first = (
        views.withColumn("view_port", view_port())
        .groupBy(*keys)
        .agg(F.min_by("view", "position").alias("view"))
    )
    return attach(events.withColumn("view_port", view_port()), settle(first), keys, "left").drop("view_port")


def newest(entries: DataFrame, order: Sequence[str] = ("block_start", "line_id"), by: str = "view") -> DataFrame:
    """The last entry of each view, by its first part."""
    rest = [c for c in entries.columns if c != by]
    top = entries.filter(entry_once(entries)).groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return top.select(by, "row.*")


def tail(entries: DataFrame, n: int, order: Sequence[str] = ORDER) -> DataFrame:
    """The last ``n`` entries of one view, by their first parts, newest first (a top-n, no full sort)."""
    return entries.filter(entry_once(entries)).orderBy(*[F.col(c).desc() for c in order if c in entries.columns]).limit(n)
