"""The driver tables as log text: inputs for queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import scratch_path

# Line ids leave room for the lines of one entry; chunks then hold the lines of 1024 entries.
ENTRY_BITS = 20
CHUNK_BITS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than cores over all cores, ahead of regex or Python work; larger inputs as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stamp(pattern: str, ts: str = "ts") -> Column:
    return F.date_format(ts, pattern)


def event_level() -> Column:
    return F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the parts of a log entry and their place in a source."""
    return spread(table(spark, sf_dir, "events")).select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.col("event_type").alias("view"),
        event_level().alias("lvl"),
        F.concat(F.lit("user-"), "user_id").alias("thr"),
        F.concat(F.lit("app.web."), "event_type").alias("log"),
        F.concat(F.col("event_id").cast("string"), F.lit(" "), "props").alias("msg"),
        F.concat("event_type", F.lit("-"), stamp("yyyy-MM-dd"), F.lit(".log")).alias("source"),
        F.lit(0).cast("long").alias("block_start"),
        F.shiftleft(F.col("event_id"), ENTRY_BITS).alias("line_id"),
    ).withColumn("source_path", F.concat(F.lit("/logs/"), "source"))


def default_line() -> Column:
    """An event in the default layout."""
    return F.concat(
        stamp("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), "thr", F.lit("] "), "lvl", F.lit(" "), "log", F.lit(" - "), "msg"
    )


LINE = ("source_path", "source", "block_start", "line_id", "value", "view", "event_id")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event in the default layout."""
    return events(spark, sf_dir).withColumn("value", default_line()).select(*LINE)


def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, to follow the event of the same number like a stack trace."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("event_id"), F.posexplode(F.split("text", "\n")).alias("pos", "value")
    )
    at = events(spark, sf_dir).select("source_path", "source", "block_start", "line_id", "view", "event_id")
    return at.join(docs, "event_id").withColumn("line_id", F.col("line_id") + F.col("pos") + 1).select(*LINE)


def event_lines_with_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).unionByName(body_lines(spark, sf_dir))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parsed entries in views by event type, without going through text."""
    return events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        F.col("lvl").alias("level"),
        F.col("thr").alias("thread"),
        F.col("log").alias("logger"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string")).alias("ip"),
        F.lit(0).alias("port"),
        F.col("msg").alias("message"),
        "source",
        default_line().alias("raw"),
        "source_path",
        "block_start",
        "line_id",
        F.lit(0).alias("part"),
        "view",
        "event_id",
    )


def write_logs(lines: DataFrame, name: str, folder: str = "source", compression: str = "none") -> str:
    """Write lines as text files, one sub-folder per value of ``folder``; returns the path below the shared folder."""
    path = scratch_path(lines.sparkSession, name)
    (
        lines.select(F.col(folder).alias("folder"), "block_start", "line_id", "value")
        .repartitionByRange("folder", "block_start", "line_id")
        .sortWithinPartitions("folder", "block_start", "line_id")
        .select("folder", "value")
        .write.partitionBy("folder")
        .option("compression", compression)
        .text(path)
    )
    return path


def folder_of(path: Column) -> Column:
    """The value of ``folder`` a file was written under."""
    return F.regexp_extract(path, r"/folder=([^/]+)/", 1)


def container_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container listing out of suppliers: (line_no, line), in all three separators."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def slug(c):
        return F.lower(F.replace(F.col(c), F.lit(" "), F.lit("-")))

    key = F.col("s_suppkey")
    pod = F.concat(slug("n_name"), F.lit("-"), key.cast("string"))
    names = F.when(key % 5 == 0, "").when(key % 5 == 1, "app").when(key % 5 == 2, "app,proxy").otherwise("app,proxy,db")
    sep = F.when(key % 3 == 0, "|").when(key % 3 == 1, "\t").otherwise("   ")
    return rows.select(key.alias("line_no"), F.concat(slug("r_name"), sep, pod, sep, names).alias("line"))
