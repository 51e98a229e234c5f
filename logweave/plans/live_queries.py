"""Queries for live events: order across micro-batches, silent connections, running facets and followed tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.plans import rendering as r
from logweave.plans.load import stored
from logweave.plans.queries import EVENTS, query
from logweave.plans.view_queries import drain, xml_lines
from logweave.schema import DISCONNECT, REMOTE_APP
from logweave.session import scratch_path
from logweave.streaming import live, ordered, sessions, tables

IDLE = 12 * 3600
DELAY = 2 * 86400
BATCHES = 6
TAIL = 50
# Groups that the connections of a stream keep their state in.
BUCKETS = 256
# Rows of a file that a micro-batch of late events is made of.
FILE_ROWS = 250_000


def delivered(rows: DataFrame, name: str, end: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream of ``rows`` in ``BATCHES`` micro-batches, each row late by up to ``DELAY`` seconds; ``end`` comes last.

    Late by a hash of the row, so that neighbours in time arrive in different micro-batches and out of order. The rows are made
    once and kept; a micro-batch is the same number of files each time, written by as many tasks.
    """
    spark = rows.sparkSession
    seconds = F.unix_seconds("ts")
    late = stored(rows.withColumn("arrival", seconds + F.pmod(F.xxhash64("remote", "seq"), F.lit(DELAY - 1))), f"{name}-rows")
    first, last, n = late.agg(F.min("arrival"), F.max("arrival"), F.count(F.lit(1))).first()
    first, last = first or 0, last or 0
    turn = F.floor((F.col("arrival") - first) * BATCHES / F.lit(last - first + 1))
    files = n // (BATCHES * file_rows) + 1
    path = scratch_path(spark, name)
    for k in range(BATCHES):
        part = late.filter(turn == k).drop("arrival")
        part = part.unionByName(end) if k == BATCHES - 1 else part
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
        # A task without rows writes no file; an empty one stands in for it, so that no micro-batch takes files of the next.
        for _ in range(files * (k + 1) - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def closing(rows: DataFrame) -> DataFrame:
    """One row of a connection of its own, later than all others by more than delay and idle time: it moves the watermark on."""
    end = rows.agg(F.timestamp_seconds(F.coalesce(F.max(F.unix_seconds("ts")), F.lit(0)) + DELAY + IDLE + 60).alias("ts"))
    known = {"remote": F.lit("end"), "seq": F.lit(0).cast("long"), "event_kind": F.lit(DISCONNECT), "ts": F.col("ts")}
    types = {f.name: f.dataType for f in rows.schema.fields}
    return end.select(*[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in rows.columns])


def _connections(spark, sf_dir) -> DataFrame:
    """Events as live events on the connection of their user; a sign-up ends it."""
    return r.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("remote"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", DISCONNECT).otherwise("event").alias("event_kind"),
        F.when(F.col("event_type") == "view", REMOTE_APP).otherwise(F.col("event_type")).alias("source"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 5).alias("ip"),
        (F.col("user_id") + 9000).cast("int").alias("port"),
        ordered.instant("ts").alias("ts"),
    )


_IDLE_SESSIONS = f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS remote, event_id AS seq, ts, event_type, user_id FROM events),
    g AS (SELECT *, CASE WHEN event_type = 'signup' OR lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > to_seconds({IDLE})
                         THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY remote ORDER BY ts, seq)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY remote ORDER BY ts, seq) AS session FROM g),
    k AS (SELECT *, first_value(event_type) OVER (PARTITION BY remote, session ORDER BY ts, seq) AS app FROM s
          WHERE event_type <> 'signup')
    SELECT remote, seq, CASE WHEN app = 'view' THEN 'Remote(10.0.0.' || user_id % 5 || ':' || 9000 + user_id || ')'
                             ELSE app || ' (10.0.0.' || user_id % 5 || ')' END AS view FROM k"""


@query("j04_idle_sessions", _IDLE_SESSIONS)
def j04_idle(spark, sf_dir):
    return sessions.route_with_idle(_connections(spark, sf_dir), IDLE).select("remote", "seq", "view")


@query("j04_idle_sessions_stream", _IDLE_SESSIONS)
def j04_idle_stream(spark, sf_dir):
    live.use_rocksdb(spark)
    rows = _connections(spark, sf_dir)
    return drain(ordered.route_in_order(delivered(rows, "j04-late", closing(rows)), IDLE, DELAY, buckets=BUCKETS), "j04-idle")


_FRAMES = """
xm AS (SELECT '10.0.0.9:' || user_id AS remote,
              '<log4j:event logger="' || log || '" timestamp="' || epoch_us(ts) // 1000 || '" level="' || lvl || '" thread="' || thr
              || '">' || chr(10) || '<log4j:message><![CDATA[' || msg || ']]></log4j:message>' || chr(10)
              || CASE WHEN lvl = 'ERROR' THEN '<log4j:throwable><![CDATA[Boom' || chr(10) || chr(9) || 'at shop]]></log4j:throwable>' ELSE '' END
              || chr(10) || '</log4j:event>' || chr(10) AS xml FROM ev)"""


@query("j01_xml_frames_in_order", f"WITH {EVENTS}, {_FRAMES} SELECT remote, xml FROM xm")
def j01_in_order(spark, sf_dir):
    live.use_rocksdb(spark)
    times = r.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ordered.instant("ts").alias("ts"))
    lines = xml_lines(spark, sf_dir).withColumn("id", F.floor(F.col("seq") / 8))
    lines = lines.join(times, "id").drop("id")
    stream = ordered.frame_in_order(delivered(lines, "j01-late", closing(lines)), IDLE, DELAY, buckets=BUCKETS)
    return drain(stream, "j01-ordered").select("remote", "xml")


def _entry_stream(spark, sf_dir, name) -> DataFrame:
    """Entries that arrive in ``BATCHES`` micro-batches."""
    rows = r.event_entries(spark, sf_dir).select("timestamp", "level", "thread", "logger", "ip", "message", "source", "view", "event_id")
    path = scratch_path(spark, name)
    rows.repartition(BATCHES, F.xxhash64("event_id")).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "j05_running_facets",
    f"""WITH {EVENTS} SELECT 'level' AS facet, lvl AS value, count(*) AS n FROM ev GROUP BY ALL
        UNION ALL SELECT 'thread', thr, count(*) FROM ev GROUP BY ALL UNION ALL SELECT 'logger', event_type, count(*) FROM ev GROUP BY ALL
        UNION ALL SELECT 'ip', ip, count(*) FROM ev GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM ev GROUP BY ALL""",
)
def j05_facets(spark, sf_dir):
    path = scratch_path(spark, "j05-facets")
    stream = _entry_stream(spark, sf_dir, "j05-facets-in")
    tables.follow_facets(stream, path, scratch_path(spark, "j05-facets-offsets"), available_now=True).awaitTermination()
    return tables.facets_table(spark, path).current()


@query(
    "j05_tail",
    f"""WITH {EVENTS} SELECT view, event_id, ts AS timestamp, msg AS message FROM ev
        QUALIFY row_number() OVER (PARTITION BY view ORDER BY ts DESC, event_id DESC) <= {TAIL}""",
)
def j05_tail(spark, sf_dir):
    path = scratch_path(spark, "j05-tail")
    stream = _entry_stream(spark, sf_dir, "j05-tail-in").select("view", "event_id", "timestamp", "message")
    order = ["timestamp", "event_id"]
    tables.follow_tail(stream, TAIL, order, path, scratch_path(spark, "j05-tail-offsets"), available_now=True).awaitTermination()
    return tables.tail_table(stream, path).current()
