"""Tables that a stream keeps up to date: the newest rows per key, running facets and the tail of each view."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.predicates import FACETS
from logweave.session import small_side

VERSION = "version"
# Versions after which the table is written anew as a whole.
FOLD = 16


class LatestTable:
    """A Parquet table of rows by key below ``path``, replaced key by key.

    Each micro-batch is written as one version that holds all rows of the keys it changes; a reader takes each key from
    its newest version. A version is overwritten if its batch is repeated after a failure, so a batch counts once. Every
    ``FOLD``-th version is a whole table, and readers start there; a half-written one has no success mark and is passed over.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path, list(keys), schema

    def _versions(self) -> list[int]:
        """Numbers of the finished versions."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        done = []
        for entry in store.listStatus(root):
            if store.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                done.append(int(entry.getPath().getName().split("=")[1]))
        return sorted(done)

    def replace(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` the rows of their keys."""
        if version and version % FOLD == 0:
            old = self.current(before=version)
            rows = rows.unionByName(old.join(rows.select(*self.keys).distinct(), self.keys, "left_anti"))
        rows.write.mode("overwrite").parquet(f"{self.path}/{VERSION}={version}")

    def current(self, before: int | None = None) -> DataFrame:
        """The newest rows of every key."""
        versions = [v for v in self._versions() if before is None or v < before]
        whole = max((v for v in versions if v and v % FOLD == 0), default=0)
        paths = [f"{self.path}/{VERSION}={v}" for v in versions if v >= whole]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        names = self.spark.createDataFrame([], self.schema).columns
        rows = self.spark.read.schema(f"{self.schema}, {VERSION} int").option("basePath", self.path).parquet(*paths)
        newest = rows.groupBy(*self.keys).agg(F.max(VERSION).alias(VERSION))
        return rows.join(newest, [*self.keys, VERSION]).select(*names)


def keep_current(stream: DataFrame, change: Callable[[DataFrame, int], None], checkpoint: str, mode: str, available_now: bool = False):
    """Run ``change(micro-batch, its number)`` for every micro-batch; returns the running query."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(change)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def running_facets(entries: DataFrame) -> DataFrame:
    """Counts per facet value, for output mode ``update``; counted per partition before the shuffle."""
    rows = [F.struct(F.lit(f).alias("facet"), v().alias("value")) for f, v in FACETS.items()]
    return (
        entries.select(F.inline(F.array(*rows)))
        .filter(F.col("value") != "")
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def facets_table(spark: SparkSession, path: str) -> LatestTable:
    return LatestTable(spark, path, ["facet", "value"], "facet string, value string, n long")


def follow_facets(entries: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Keep the table of facet counts up to date; only the counts that changed are written by a micro-batch."""
    table = facets_table(entries.sparkSession, path)
    return keep_current(running_facets(entries), table.replace, checkpoint, "update", available_now)


def tail_table(entries: DataFrame, path: str) -> LatestTable:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return LatestTable(entries.sparkSession, path, ["view"], schema)


def follow_tail(entries: DataFrame, n: int, order: Sequence[str], path: str, checkpoint: str, available_now: bool = False):
    """Keep the last ``n`` rows of every view, by ``order``, up to date.

    Per micro-batch the last rows of its views and those kept so far are merged; the partial top-n before the shuffle keeps
    a view with many rows from meeting in one task, and the table never has more than ``n`` rows per view.
    """
    table = tail_table(entries, path)
    last = Window.partitionBy("view").orderBy(*[F.col(c).desc() for c in order])

    def newest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_place", F.row_number().over(last)).filter(F.col("_place") <= n).drop("_place")

    def change(rows: DataFrame, version: int) -> None:
        rows = newest(rows).persist()
        views = rows.select("view").distinct()
        kept = table.current(before=version).join(small_side(views) or views, "view", "left_semi")
        table.replace(newest(rows.unionByName(kept)), version)
        rows.unpersist()

    return keep_current(entries, change, checkpoint, "append", available_now)
