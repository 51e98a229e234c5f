"""Order-dependent lookups that stay parallel inside one large group.

A plain window over a group puts the group into one task. Here a group is cut into ordered buckets of
bounded size; a small summary, one row per bucket, carries results across bucket borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import attach, scratch_path, settle, small_side


def wall_seconds(timestamp) -> Column:
    """Seconds since 1970 of a wall-clock time, independent of the session time zone."""
    ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    day = F.unix_date(ts.cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def with_positions(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "position") -> DataFrame:
    """Add ``out``: the number of each row in the order, from 1, within its group of ``by`` or over all rows.

    The rows are split by range and sorted in parallel; a number is the row's place in its range plus the rows of its group
    in the ranges before. Only one small row per range and group goes through a window, so one group, or no group at
    all, is no single task's load. ``order`` should tell all rows apart, and ``by`` must not be null.
    """
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = placed.withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_row", 33))
    path = scratch_path(df.sparkSession, "positions")
    placed.write.parquet(path)
    placed = df.sparkSession.read.schema(placed.schema).parquet(path)
    ranges = settle(placed.groupBy(*by, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).drop("_first", "_n")
    found = attach(placed, ranges, [*by, "_range"], "inner")
    return found.withColumn(out, F.col("_row") + F.col("_offset")).drop("_row", "_range", "_offset")


def carry_forward(df: DataFrame, by: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row of its group.

    ``bucket`` must grow with ``order`` and hold a bounded number of rows. One shuffle by bucket; the join
    with the carried values uses the same partitioning.
    """
    keys = [*by, "_bucket"]
    seen = df.withColumn("_bucket", bucket).withColumn("_value", value)
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct(*order)
    ends = seen.groupBy(*keys).agg(
        F.max_by(F.when(F.col("_value").isNotNull(), F.col("_value")), F.when(F.col("_value").isNotNull(), position)).alias("_end")
    )
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return (
        seen.withColumn("_local", F.last("_value", ignorenulls=True).over(local))
        .join(carried, keys, "left")
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_bucket", "_value", "_local", "_carried")
    )


def ceiling_lookup(points: DataFrame, queries: DataFrame, group: list[str]) -> DataFrame:
    """First point at or after each query of its group, or the last point of the group if there is none.

    ``points`` has the group columns, ``bucket`` (growing with ``pos``), ``pos`` and ``hit``; of several
    points at one position the smallest ``hit`` counts, and the largest when the last point stands in.
    ``queries`` has the group columns, ``bucket`` and ``pos``. The result has one row per distinct query
    with ``hit`` (null if the group has no point) and ``clamped``.

    Points are reduced to one row per position and to the buckets that hold queries, so a bucket has a
    bounded number of rows however often a position repeats.
    """
    keys = [*group, "bucket"]
    asked = settle(queries.select(*keys, "pos").distinct())
    asked_buckets = asked.select(*keys).distinct()

    summary = points.groupBy(*keys).agg(
        F.min(F.struct("pos", "hit")).alias("first"), F.max(F.struct("pos", "hit")).alias("last")
    )
    marks = summary.withColumn("asked", F.lit(False)).unionByName(
        asked_buckets.withColumn("asked", F.lit(True)), allowMissingColumns=True
    )
    marks = marks.groupBy(*keys).agg(
        F.max("first").alias("first"), F.max("last").alias("last"), F.max("asked").alias("asked")
    )
    later = Window.partitionBy(*group).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        marks.withColumn("next", F.last("first", ignorenulls=True).over(later)["hit"])
        .withColumn("final", F.max("last").over(Window.partitionBy(*group))["hit"])
        .filter("asked")
        .select(
            *keys,
            F.lit(None).cast(asked.schema["pos"].dataType).alias("pos"),
            F.struct(F.coalesce("next", "final").alias("hit"), F.col("next").isNull().alias("clamped")).alias("found"),
            F.lit(0).alias("turn"),
        )
    )

    near = points.join(small_side(asked_buckets) or asked_buckets, keys, "left_semi")
    near = near.groupBy(*keys, "pos").agg(F.min("hit").alias("hit"))
    near = near.select(
        *keys, "pos", F.struct("hit", F.lit(False).alias("clamped")).alias("found"), F.lit(1).alias("turn")
    )
    wanted = asked.select(*keys, "pos", F.lit(None).cast(ends.schema["found"].dataType).alias("found"), F.lit(2).alias("turn"))

    # Descending, so that "the next point" is a running value; the mark from later buckets comes first.
    backwards = (
        Window.partitionBy(*keys)
        .orderBy(F.col("pos").desc_nulls_first(), F.col("turn"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ends.unionByName(near)
        .unionByName(wanted)
        .withColumn("found", F.last("found", ignorenulls=True).over(backwards))
        .filter(F.col("turn") == 2)
        .select(*group, "pos", "found.hit", "found.clamped")
    )
