"""Queries for reading, parsing, stitching and format detection."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from logweave.functions.fields import workload_name
from logweave.operators.detect import choose_format, detect_formats, heads_of, parse_detected, score_formats
from logweave.operators.formats import (
    FALLBACK,
    ColumnFormat,
    FormatSet,
    Layout,
    Mixed,
    RegexFormat,
    default_formats,
)
from logweave.operators.parse import parse_lines, read_lines as read_fields
from logweave.plans import rendering as r
from logweave.plans.queries import EVENTS, LINES, query
from logweave.session import settle
from logweave.sources import archives, containers, files

DEFAULT = Layout("%d{yyyy-MM-dd HH:mm:ss.SSS} [%t] %-5level %logger{36} - %msg%n")
BRACKET = RegexFormat(
    "bracketed time", r"^\[.*\] .*", r"^\[(.*?)\]\s+(\w+)\s+(.*)$", "yyyy-MM-dd HH:mm:ss", level=2, message=3
)
BASE_DATE = "2024-06-15"
FIELD_COLUMNS = [f"fields.{c}" for c in ("timestamp", "level", "thread", "logger", "ip", "message")]


# --- sources ---------------------------------------------------------------------------------------------


@query("a01_text_lines", f"WITH {LINES} SELECT source, line AS value FROM ln")
def a01(spark, sf_dir):
    path = r.write_logs(r.event_lines(spark, sf_dir), "a01")
    return files.read_lines(spark, path).select(r.folder_of(F.col("source_path")).alias("source"), "value")


_NAMES = """
names AS (
  SELECT page_id, 'page' || page_id || '-' || length(url) || '.'
         || (['log','TXT','html','Gz','7z','zip','jar','PNG','so','tar','log.bak'])[1 + (page_id + length(url)) % 11] AS name
  FROM pages
)"""


def _names(spark, sf_dir):
    endings = ["log", "TXT", "html", "Gz", "7z", "zip", "jar", "PNG", "so", "tar", "log.bak"]
    which = (F.col("page_id") + F.length("url")) % len(endings)
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (which + 1).cast("int"))
    name = F.concat(F.lit("page"), "page_id", F.lit("-"), F.length("url"), F.lit("."), ending)
    return r.table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@query(
    "a02_folder_names",
    f"WITH {_NAMES} SELECT page_id, name, regexp_matches(lower(name), '\\.(log|txt|zip|7z|gz)$') AS listed FROM names",
)
def a02(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("listed", files.is_log_name("name"))


@query("a03_many_paths", "SELECT event_type AS view, count(*) AS lines FROM events GROUP BY event_type")
def a03(spark, sf_dir):
    path = r.write_logs(r.event_lines(spark, sf_dir), "a03", folder="view")
    parts = [f"{path}/folder={v}" for v in ("click", "error", "purchase", "signup", "view", "absent")]
    lines = files.read_lines(spark, parts)
    return lines.groupBy(r.folder_of(F.col("source_path")).alias("view")).agg(F.count(F.lit(1)).alias("lines"))


_ORDER_LINES = """
ol AS (
  SELECT o_orderkey, o_orderdate, o_orderstatus, 'order ' || o_orderkey || ' of ' || o_custkey AS msg,
         'prio-' || substr(o_orderpriority, 1, 1) || '.log' AS source,
         '[' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '] ' || o_orderstatus || ' order ' || o_orderkey
         || ' of ' || o_custkey AS line
  FROM orders
)"""


def _order_lines(spark, sf_dir):
    msg = F.concat(F.lit("order "), "o_orderkey", F.lit(" of "), "o_custkey")
    source = F.concat(F.lit("prio-"), F.substring("o_orderpriority", 1, 1), F.lit(".log"))
    line = F.concat(F.lit("["), r.stamp("yyyy-MM-dd HH:mm:ss", "o_orderdate"), F.lit("] "), "o_orderstatus", F.lit(" "), msg)
    return r.spread(r.table(spark, sf_dir, "orders")).select(
        "o_orderkey",
        source.alias("source_path"),
        source.alias("source"),
        F.lit(0).cast("long").alias("block_start"),
        F.col("o_orderkey").alias("line_id"),
        line.alias("value"),
    )


@query("a04_gzip_lines", f"WITH {_ORDER_LINES} SELECT source, line AS value FROM ol")
def a04(spark, sf_dir):
    path = r.write_logs(_order_lines(spark, sf_dir), "a04", compression="gzip")
    return files.read_lines(spark, path).select(r.folder_of(F.col("source_path")).alias("source"), "value")


def _zip_of(doc_id: int, text: str, lang: str) -> bytes:
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("inner.txt", f"{lang}\n{doc_id}\n")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"logs/doc-{doc_id}.log", text)
        z.writestr("icon.png", b"\x89PNG\x00\x00")
        z.writestr("nested/inner.zip", inner.getvalue())
        z.writestr("rotated.log.1.gz", gzip.compress(lang.encode()))
    return outer.getvalue()


# Archives that a Python worker makes at once.
ARCHIVES = 200


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows, so few at once that what is made of them stays small."""
    for b in batches:
        for k in range(0, len(b), ARCHIVES):
            yield b.iloc[k : k + ARCHIVES]


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _few(batches):
        content = [_zip_of(i, t, g) for i, t, g in zip(b["doc_id"], b["text"], b["lang"])]
        yield pd.DataFrame({"path": b["doc_id"].map("doc-{}.zip".format), "content": content})


def _archives(spark, sf_dir):
    docs = r.spread(r.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.mapInPandas(_zipped, "path string, content binary")


@query(
    "a05_zip_members",
    """
    WITH body AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
    SELECT 'doc-' || doc_id || '.zip' AS archive, 'logs/doc-' || doc_id || '.log' AS member, value FROM body
    UNION ALL SELECT 'doc-' || doc_id || '.zip', 'inner.txt', lang FROM documents
    UNION ALL SELECT 'doc-' || doc_id || '.zip', 'inner.txt', CAST(doc_id AS VARCHAR) FROM documents
    UNION ALL SELECT 'doc-' || doc_id || '.zip', 'rotated.log.1.gz', lang FROM documents
    """,
)
def a05(spark, sf_dir):
    exploded = archives.explode_archives(_archives(spark, sf_dir))
    return exploded.select(F.substring_index("archive", "!", 1).alias("archive"), "member", "value")


@query(
    "a06_skipped_members",
    f"""WITH {_NAMES} SELECT page_id, name FROM names
    WHERE NOT regexp_matches(lower(name), '\\.(class|jar|exe|dll|so|png|jpg|jpeg|gif|pdf|zip|7z|gz|tar|iso)$')""",
)
def a06(spark, sf_dir):
    return _names(spark, sf_dir).filter(~files.is_skipped_name("name"))


@query(
    "a07_binary_content",
    """
    WITH bytes AS (
      SELECT doc_id, string_split_regex(regexp_replace(substr(hex(encode(t)), 1, 2048), '(..)', '\\1 ', 'g'), ' ') AS h,
             octet_length(encode(t)) AS size
      FROM (SELECT doc_id, translate(text, 'aeos', chr(1) || chr(2) || chr(127) || chr(27)) AS t FROM documents)
    ), counted AS (
      SELECT doc_id, size,
             len(list_filter(h, lambda x: x <> '' AND ((x < '20' AND x NOT IN ('09', '0A', '0D', '00')) OR x = '7F'))) AS ctl,
             len(list_filter(h, lambda x: x >= '80')) AS high
      FROM bytes
    )
    SELECT doc_id, ctl > 0.3 * least(size, 1024) AS rejected, (ctl + high) > 0.3 * size AS rejected_compat FROM counted
    """,
)
def a07(spark, sf_dir):
    content = F.translate("text", "aeos", "\x01\x02\x7f\x1b").cast("binary")
    docs = r.table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return docs.select(
        "doc_id",
        files.is_binary(F.col("content")).alias("rejected"),
        files.is_binary(F.col("content"), compat=True).alias("rejected_compat"),
    )


_CONTAINERS = """
pods AS (
  SELECT s_suppkey, replace(lower(r_name), ' ', '-') AS namespace,
         replace(lower(n_name), ' ', '-') || '-' || s_suppkey AS pod,
         CASE s_suppkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['app'] WHEN 2 THEN ['app', 'proxy'] ELSE ['app', 'proxy', 'db'] END AS names
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), flat AS (
  SELECT namespace, pod, unnest(CASE WHEN len(names) = 0 THEN [NULL] ELSE names END) AS container FROM pods
)"""


def _pods(spark, sf_dir):
    return containers.parse_listing(r.container_listing(spark, sf_dir)).drop("line_no")


@query("a08_container_listing", f"WITH {_CONTAINERS} SELECT namespace, pod, container FROM flat")
def a08(spark, sf_dir):
    return containers.flat_containers(_pods(spark, sf_dir))


@query(
    "a09_container_sources",
    f"WITH {_CONTAINERS} SELECT pod || '_' || container || '.log' AS source FROM flat WHERE container IS NOT NULL",
)
def a09(spark, sf_dir):
    flat = containers.flat_containers(_pods(spark, sf_dir)).filter(F.col("container").isNotNull())
    return flat.select(containers.container_source().alias("source"))


@query(
    "a10_rejected_sources",
    "SELECT 'doc-' || doc_id || '.zip' AS path, true AS rejected FROM documents WHERE lang <> 'en'",
)
def a10(spark, sf_dir):
    def damaged(batches):
        for b in _few(batches):
            content = [
                _zip_of(i, t, g) if g == "en" else t.encode() for i, t, g in zip(b["doc_id"], b["text"], b["lang"])
            ]
            yield pd.DataFrame({"path": b["doc_id"].map("doc-{}.zip".format), "content": content})

    docs = r.spread(r.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    exploded = archives.explode_archives(docs.mapInPandas(damaged, "path string, content binary"))
    return archives.rejected(exploded).select("path", F.lit(True).alias("rejected"))


# --- parsing ---------------------------------------------------------------------------------------------


@query(
    "b01_layout_first_lines",
    f"""WITH {LINES} SELECT event_id,
        regexp_full_match(line, '(.*?)\\s+\\[(.*?)\\]\\s+(\\w+)\\s+(.*?)\\s+-\\s+(.*)') AS fits,
        regexp_extract(line, '^(.*?)\\s+\\[(.*?)\\]\\s+(\\w+)\\s+(.*?)\\s+-\\s+(.*)$', 4) AS logger FROM ln""",
)
def b01(spark, sf_dir):
    rule = DEFAULT.rules[0]
    lines = r.event_lines(spark, sf_dir)
    return lines.select(
        "event_id",
        DEFAULT.first_line(F.col("value")).alias("fits"),
        F.regexp_extract("value", rule.regex, rule.groups[3]).alias("logger"),
    )


@query(
    "b02_layout_fields",
    f"WITH {EVENTS} SELECT event_id, ts_ms AS timestamp, lvl AS level, thr AS thread, log AS logger, '' AS ip, msg AS message FROM ev",
)
def b02(spark, sf_dir):
    return read_fields(r.event_lines(spark, sf_dir), DEFAULT).select("event_id", *FIELD_COLUMNS)


@query(
    "b03_regex_fields",
    f"""WITH {_ORDER_LINES} SELECT o_orderkey, o_orderdate AS timestamp, o_orderstatus AS level, '' AS thread,
        '' AS logger, '' AS ip, msg AS message FROM ol""",
)
def b03(spark, sf_dir):
    return read_fields(_order_lines(spark, sf_dir), BRACKET).select("o_orderkey", *FIELD_COLUMNS)


@query(
    "b04_mixed_formats",
    f"""WITH {EVENTS} SELECT event_id, ts_ms AS timestamp, lvl AS level,
        CASE WHEN event_id % 2 = 0 THEN '' ELSE thr END AS thread, msg AS message FROM ev""",
)
def b04(spark, sf_dir):
    mixed = Mixed(
        "database (mixed)",
        ["%d{yyyy-MM-dd HH:mm:ss,SSS} %level: %msg%n", "%d{yyyy-MM-dd HH:mm:ss.SSS} UTC [%t] %level %msg%n"],
    )
    first = F.concat(r.stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), "lvl", F.lit(": "), "msg")
    second = F.concat(r.stamp("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC ["), "thr", F.lit("] "), "lvl", F.lit(" "), "msg")
    lines = r.events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 2 == 0, first).otherwise(second))
    read = read_fields(lines, mixed)
    return read.select("event_id", *[f"fields.{c}" for c in ("timestamp", "level", "thread", "message")])


@query(
    "b05_stitched_entries",
    f"""WITH {LINES} SELECT ln.source, ts_ms AS timestamp, lvl AS level, log AS logger,
        msg || coalesce(chr(10) || text, '') AS message, line || coalesce(chr(10) || text, '') AS raw
        FROM ln LEFT JOIN documents ON doc_id = event_id""",
)
def b05(spark, sf_dir):
    lines = r.event_lines_with_bodies(spark, sf_dir)
    entries = parse_lines(lines, DEFAULT, chunk_bits=r.CHUNK_BITS)
    return entries.select("source", "timestamp", "level", "logger", "message", "raw")


@query(
    "b06_headers",
    f"""WITH {LINES}, heads AS (
      SELECT source || '.log' AS source, string_agg(text, chr(10) ORDER BY doc_id) AS message FROM documents GROUP BY source)
    SELECT source, NULL::TIMESTAMP AS timestamp, '' AS level, message FROM heads
    UNION ALL SELECT 'src' || (user_id % 20) || '.log', ts_ms, lvl, msg FROM ln""",
)
def b06(spark, sf_dir):
    docs = r.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit(".log")).alias("source"),
        F.lit(0).cast("long").alias("block_start"),
        "doc_id",
        F.posexplode(F.split("text", "\n")).alias("pos", "value"),
    )
    head = docs.withColumn("line_id", F.shiftleft("doc_id", r.ENTRY_BITS) + F.col("pos")).drop("doc_id", "pos")
    body = r.events(spark, sf_dir).select(
        F.concat(F.lit("src"), F.col("user_id") % 20, F.lit(".log")).alias("source"),
        F.lit(1).cast("long").alias("block_start"),
        r.default_line().alias("value"),
        "line_id",
    )
    lines = head.unionByName(body).withColumn("source_path", F.col("source"))
    return parse_lines(lines, DEFAULT, chunk_bits=r.CHUNK_BITS).select("source", "timestamp", "level", "message")


@query(
    "b07_raw_lines",
    """SELECT doc_id, NULL::TIMESTAMP AS timestamp, '' AS level, value AS message, value AS raw
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)""",
)
def b07(spark, sf_dir):
    docs = r.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("source_path"),
        F.col("doc_id").cast("string").alias("source"),
        F.lit(0).cast("long").alias("block_start"),
        F.posexplode(F.split("text", "\n")).alias("line_id", "value"),
    )
    lines = docs.withColumn("line_id", F.col("line_id").cast("long")).withColumn("format_index", F.lit(FALLBACK))
    fmt = FormatSet(default_formats(), F.col("format_index"))
    entries = parse_lines(lines, fmt, keep=("doc_id", "format_index"))
    return entries.select("doc_id", "timestamp", "level", "message", "raw")


@query(
    "b08_time_only",
    f"""WITH {EVENTS} SELECT event_id, TIMESTAMP '{BASE_DATE} 00:00:00' + (ts_ms - date_trunc('day', ts_ms)) AS timestamp,
        lvl AS level, thr AS thread, log AS logger, msg AS message FROM ev""",
)
def b08(spark, sf_dir):
    fmt = Layout("%d{HH:mm:ss.SSS} [%t] %level  %logger - %msg%n")
    line = F.concat(
        r.stamp("HH:mm:ss.SSS"), F.lit(" ["), "thr", F.lit("] "), "lvl", F.lit("  "), "log", F.lit(" - "), "msg"
    )
    read = read_fields(r.events(spark, sf_dir).withColumn("value", line), fmt, base_date=BASE_DATE)
    return read.select("event_id", *[f"fields.{c}" for c in ("timestamp", "level", "thread", "logger", "message")])


@query(
    "b09_offset_dropped",
    f"""WITH {EVENTS} SELECT event_id, date_trunc('second', ts) AS timestamp, ip,
        '"GET /' || event_type || '" 200' AS message FROM ev""",
)
def b09(spark, sf_dir):
    fmt = Layout("%h - - [%d{dd/MMM/yyyy:HH:mm:ss Z}] %msg%n")
    offset = F.when(F.col("event_id") % 2 == 0, "+0200").otherwise("-0730")
    line = F.concat(
        F.lit("10.0.0."), F.col("user_id") % 4, F.lit(" - - ["), r.stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(" "), offset,
        F.lit('] "GET /'), "event_type", F.lit('" 200'),
    )
    read = read_fields(r.events(spark, sf_dir).withColumn("value", line), fmt)
    return read.select("event_id", "fields.timestamp", "fields.ip", "fields.message")


def _by_view(spark, sf_dir):
    """Every event type in a format of its own."""
    view = F.col("event_type")
    quarkus = F.concat(r.stamp("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), "lvl", F.lit(" ["), "log", F.lit("] ("), "thr", F.lit(") "), "msg")
    named = F.concat(
        r.stamp("dd-MMM-yyyy HH:mm:ss.SSS"), F.lit(" "), "lvl", F.lit(" ["), "thr", F.lit("] "), "log", F.lit(" "), "msg"
    )
    tabs = F.concat(r.stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z\t"), F.lower("lvl"), F.lit("\t"), "msg", F.lit("\t"), "log")
    access = F.concat(F.lit("10.0.0."), F.col("user_id") % 4, F.lit(" - - ["), r.stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] "), "msg")
    line = F.when(view == "click", quarkus).when(view == "error", named).when(view == "view", tabs).when(view == "signup", access)
    return r.events(spark, sf_dir).withColumn("value", line.otherwise(r.default_line())).select(*r.LINE)


_WINNER = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 7 WHEN 'view' THEN 14 WHEN 'signup' THEN 17 ELSE 1 END"


@query("b10_detected_format", f"WITH {EVENTS} SELECT DISTINCT source, CAST({_WINNER} AS INTEGER) AS format_index FROM ev")
def b10(spark, sf_dir):
    lines = _by_view(spark, sf_dir)
    found = detect_formats(settle(heads_of(lines, chunk_bits=r.CHUNK_BITS)), base_date=BASE_DATE)
    return found.select(F.substring_index("source_path", "/", -1).alias("source"), "format_index")


@query(
    "b10_parsed_by_detection",
    f"""WITH {EVENTS} SELECT source,
        CASE event_type WHEN 'click' THEN ts_ms WHEN 'view' THEN ts WHEN 'signup' THEN date_trunc('second', ts) ELSE ts_ms END AS timestamp,
        CASE event_type WHEN 'signup' THEN '' WHEN 'view' THEN lower(lvl) ELSE lvl END AS level,
        CASE WHEN event_type = 'signup' THEN '' ELSE log END AS logger,
        CASE WHEN event_type IN ('click', 'purchase', 'error') THEN thr ELSE '' END AS thread,
        CASE WHEN event_type = 'signup' THEN ip ELSE '' END AS ip, msg AS message FROM ev""",
)
def b10_parsed(spark, sf_dir):
    lines = _by_view(spark, sf_dir)
    entries = parse_detected(lines, base_date=BASE_DATE, chunk_bits=r.CHUNK_BITS)
    return entries.select("source", "timestamp", "level", "logger", "thread", "ip", "message")


@query(
    "f07_format_scores",
    f"""WITH {EVENTS} SELECT source, CAST({_WINNER} AS INTEGER) AS format_index, true AS candidate, count(*) AS timed,
        count(*) AS total FROM ev GROUP BY ALL""",
)
def f07(spark, sf_dir):
    heads = heads_of(_by_view(spark, sf_dir), chunk_bits=r.CHUNK_BITS)
    scores = score_formats(heads, base_date=BASE_DATE)
    return (
        scores.join(choose_format(scores), ["source_path", "format_index"])
        .withColumn("source", F.substring_index("source_path", "/", -1))
        .select("source", "format_index", "candidate", "timed", "total")
    )


def _all_formats(spark, sf_dir):
    """Event n in built-in format n mod 19.

    The first blank ends the time stamp of format 8, whose pattern needs more than one word: no line fits it.
    """
    ms, comma = r.stamp("yyyy-MM-dd HH:mm:ss.SSS"), r.stamp("yyyy-MM-dd HH:mm:ss,SSS")
    sp = F.lit(" ")
    renders = [
        F.concat(comma, sp, "lvl", F.lit(" ["), "log", F.lit("] ("), "thr", F.lit(") "), "msg"),
        r.default_line(),
        F.concat(comma, F.lit(" ["), "thr", F.lit("] ("), "log", F.lit(") - "), "msg"),
        F.concat("lvl", sp, comma, F.lit(" ["), "thr", F.lit("] ("), "log", F.lit(") - "), "msg"),
        F.concat(r.stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" : "), "msg"),
        F.concat(comma, sp, "lvl", F.lit(" - "), "msg"),
        F.concat(F.lit("["), r.stamp("MMdd/HHmmss.SSS"), F.lit(":"), "lvl", F.lit(":"), "log", F.lit("] "), "msg"),
        F.concat(r.stamp("dd-MMM-yyyy HH:mm:ss.SSS"), sp, "lvl", F.lit(" ["), "thr", F.lit("] "), "log", sp, "msg"),
        F.concat(r.stamp("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" CET "), "lvl", sp, "log", F.lit(" > "), "msg"),
        F.concat("lvl", sp, ms, F.lit(" ["), "thr", F.lit("] "), "log", F.lit(": "), "msg"),
        F.concat(r.stamp("HH:mm:ss.SSS"), F.lit(" ["), "thr", F.lit("] "), "lvl", F.lit("  "), "log", F.lit(" - "), "msg"),
        F.concat(comma, sp, "lvl", sp, "thr", F.lit(" ["), "log", F.lit("] "), "msg"),
        F.concat(r.stamp("HH:mm:ss,SSS"), F.lit(" |-"), "lvl", F.lit(" in "), "log", F.lit(" - "), "msg"),
        F.concat(r.stamp("HH:mm:ss.SSS"), sp, "lvl", sp, "log", F.lit(" - "), "msg"),
        F.concat(r.stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z\t"), "lvl", F.lit("\t"), "msg", F.lit("\t"), "log"),
        F.concat(r.stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z  "), "lvl", F.lit(" 17 --- [shop] ["), "thr", F.lit("] "), "log", F.lit(" : "), "msg"),
        F.concat(ms, F.lit(" UTC ["), "thr", F.lit("] "), "lvl", sp, "msg"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 4, F.lit(" - - ["), r.stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(" -0330] "), "msg"),
        F.concat(F.lit("["), r.stamp("yyyy-MM-dd HH:mm:ss"), F.lit("] "), "lvl", sp, "msg"),
    ]
    n = (F.col("event_id") % len(renders)).cast("int")
    value = F.lit(None).cast("string")
    for i, text in enumerate(renders):
        value = F.when(n == i, text).otherwise(value)
    return r.events(spark, sf_dir).withColumn("format_index", n).withColumn("value", value)


@query(
    "b11_builtin_formats",
    f"""WITH {EVENTS}, f AS (SELECT *, CAST(event_id % 19 AS INTEGER) AS n,
             TIMESTAMP '{BASE_DATE} 00:00:00' + (ts_ms - date_trunc('day', ts_ms)) AS clock FROM ev)
    SELECT event_id, n AS format_index,
           CASE WHEN n IN (6, 10, 12, 13) THEN clock WHEN n IN (4, 17, 18) THEN date_trunc('second', ts)
                WHEN n = 14 THEN ts WHEN n <> 8 THEN ts_ms END AS timestamp,
           CASE WHEN n IN (2, 4, 17) THEN '' WHEN n <> 8 THEN lvl END AS level,
           CASE WHEN n IN (0, 1, 2, 3, 7, 9, 10, 11, 16) THEN thr WHEN n = 15 THEN 'shop' WHEN n <> 8 THEN '' END AS thread,
           CASE WHEN n IN (4, 5, 16, 17, 18) THEN '' WHEN n <> 8 THEN log END AS logger,
           CASE WHEN n = 17 THEN ip WHEN n <> 8 THEN '' END AS ip, CASE WHEN n <> 8 THEN msg END AS message FROM f""",
)
def b11(spark, sf_dir):
    fmt = FormatSet(default_formats(), F.col("format_index"))
    # rows of one format together, so that each task compiles each regex once
    lines = _all_formats(spark, sf_dir).sortWithinPartitions("format_index")
    return read_fields(lines, fmt, base_date=BASE_DATE).select("event_id", "format_index", *FIELD_COLUMNS)


@query(
    "b12_custom_format",
    f"""WITH {EVENTS} SELECT source, CAST(19 AS INTEGER) AS format_index, date_trunc('minute', ts) AS timestamp,
        lvl AS level, msg AS message FROM ev""",
)
def b12(spark, sf_dir):
    formats = [*default_formats(), Layout("%d{dd.MM.yyyy HH:mm} %level %msg")]
    line = F.concat(r.stamp("dd.MM.yyyy HH:mm"), F.lit(" "), "lvl", F.lit(" "), "msg")
    lines = r.events(spark, sf_dir).withColumn("value", line).select(*r.LINE)
    entries = parse_detected(lines, formats, base_date=BASE_DATE, chunk_bits=r.CHUNK_BITS)
    return entries.select("source", "format_index", "timestamp", "level", "message")


@query(
    "b13_first_line_tests",
    f"""WITH {LINES} SELECT event_id, regexp_full_match(line, '.*? : .*') AS plain, true AS standard,
        regexp_full_match(line, '\\[.*\\] .*') AS bracket, true AS any_of, true AS fallback FROM ln""",
)
def b13(spark, sf_dir):
    line = F.col("value")
    formats = default_formats()
    fallback = FormatSet(formats, F.lit(FALLBACK))
    mixed = Mixed("either", ["%d{HH:mm} %msg", formats[1].layout])
    return r.event_lines(spark, sf_dir).select(
        "event_id",
        formats[4].first_line(line).alias("plain"),
        formats[1].first_line(line).alias("standard"),
        formats[18].first_line(line).alias("bracket"),
        mixed.first_line(line).alias("any_of"),
        fallback.first_line(line).alias("fallback"),
    )


@query(
    "l01_column_format",
    f"WITH {EVENTS} SELECT event_id, ts_ms AS timestamp, lvl AS level, '' AS thread, log AS logger, '' AS ip, msg AS message FROM ev",
)
def l01(spark, sf_dir):
    def fields(line):
        got = [F.regexp_extract(line, rf"{k}=(\S+)", 1) for k in ("time", "level", "logger")]
        ts = F.translate(got[0], "T", " ").try_cast("timestamp_ntz")
        message = F.regexp_extract(line, r"text=(.*)$", 1)
        values = [ts, got[1], F.lit(""), got[2], F.lit(""), message]
        names = ["timestamp", "level", "thread", "logger", "ip", "message"]
        return F.when(ts.isNotNull(), F.struct(*[v.alias(n) for v, n in zip(values, names)]))

    fmt = ColumnFormat("key=value", lambda line: line.startswith("time="), fields)
    line = F.concat(
        F.lit("time="), r.stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(" level="), "lvl", F.lit(" logger="), "log",
        F.lit(" text="), "msg",
    )
    return read_fields(r.events(spark, sf_dir).withColumn("value", line), fmt).select("event_id", *FIELD_COLUMNS)


# --- containers ------------------------------------------------------------------------------------------


@query(
    "c07_workload_names",
    f"""WITH {_CONTAINERS} SELECT pod, regexp_replace(pod, '-(?:[a-z0-9]{{8,15}}-[a-z0-9]{{5}}|[0-9]+)$', '') AS workload FROM pods
    UNION ALL SELECT p, regexp_replace(p, '-(?:[a-z0-9]{{8,15}}-[a-z0-9]{{5}}|[0-9]+)$', '')
    FROM (SELECT 'shop-' || substr(md5(s_name), 1, 10) || '-' || substr(md5(s_name), 12, 5) AS p FROM supplier)""",
)
def c07(spark, sf_dir):
    md5 = F.md5("s_name")
    replica = F.concat(F.lit("shop-"), F.substring(md5, 1, 10), F.lit("-"), F.substring(md5, 12, 5))
    pods = _pods(spark, sf_dir).select("pod").unionAll(r.table(spark, sf_dir, "supplier").select(replica.alias("pod")))
    return pods.withColumn("workload", workload_name("pod"))


@query(
    "d05_container_search",
    f"""WITH {_CONTAINERS} SELECT * FROM flat WHERE contains(lower(namespace), 'rica') OR contains(lower(pod), 'rica')
        OR contains(lower(container), 'rica')""",
)
def d05(spark, sf_dir):
    return containers.filter_containers(containers.flat_containers(_pods(spark, sf_dir)), search=" RICA ")


_NAMESPACES = ["europe", "asia"]


@query(
    "d06_container_selection",
    f"""WITH {_CONTAINERS} SELECT * FROM flat WHERE namespace IN ('europe', 'asia') AND container IN ('app')
        AND regexp_replace(pod, '-[0-9]+$', '') <> 'nation_3'""",
)
def d06(spark, sf_dir):
    flat = containers.flat_containers(_pods(spark, sf_dir))
    workloads = [f"nation_{i}" for i in range(25) if i != 3]
    return containers.filter_containers(flat, {"namespace": _NAMESPACES, "container": ["app"], "pod": workloads})


@query(
    "d07_path_patterns",
    f"""WITH {_CONTAINERS}, paths AS (SELECT DISTINCT namespace, pod, container,
             namespace || '/' || pod || '/' || container AS path FROM flat WHERE container IS NOT NULL)
    SELECT namespace, pod, container, path FROM paths WHERE contains(path, 'nation_1')
       OR regexp_full_match(path, 'asia/.*/proxy') OR regexp_full_match(path, 'europe/nation_.-.*/app')""",
)
def d07(spark, sf_dir):
    flat = containers.flat_containers(_pods(spark, sf_dir))
    return containers.select_paths(flat, "nation_1, asia/*/proxy,europe/nation_?-*/app").drop("pattern")


@query(
    "i02_first_pattern_wins",
    f"""WITH {_CONTAINERS}, paths AS (SELECT DISTINCT namespace || '/' || pod || '/' || container AS path FROM flat
             WHERE container IS NOT NULL)
    SELECT path, CAST(pattern AS INTEGER) AS pattern FROM (
      SELECT path, CASE WHEN contains(path, 'nation_1') THEN 0 WHEN regexp_full_match(path, '.*/app') THEN 1
                        WHEN regexp_full_match(path, 'asia/.*') THEN 2 END AS pattern FROM paths) WHERE pattern IS NOT NULL""",
)
def i02(spark, sf_dir):
    flat = containers.flat_containers(_pods(spark, sf_dir))
    # the same listing twice: each path is still selected once, by its first pattern
    return containers.select_paths(flat.unionAll(flat), "nation_1,*/app,asia/*").select("path", "pattern")


@query(
    "f02_container_facets",
    f"""WITH {_CONTAINERS}, b AS (SELECT *, regexp_replace(pod, '-[0-9]+$', '') AS base FROM flat)
    SELECT 'namespace' AS facet, namespace AS value, count(*) AS n FROM b WHERE container IN ('proxy') AND contains(pod, 'nation_') GROUP BY ALL
    UNION ALL SELECT 'pod', base, count(*) FROM b WHERE namespace IN ('europe', 'asia') AND container IN ('proxy') GROUP BY ALL
    UNION ALL SELECT 'container', container, count(*) FROM b WHERE namespace IN ('europe', 'asia') AND container <> '' GROUP BY ALL""",
)
def f02(spark, sf_dir):
    flat = containers.flat_containers(_pods(spark, sf_dir))
    return containers.container_options(flat, {"namespace": _NAMESPACES, "container": ["proxy"]}, search="nation_")


@query(
    "f08_namespace_totals",
    f"""WITH {_CONTAINERS} SELECT namespace, count(*) AS pods, CAST(sum(len(names)) AS BIGINT) AS containers
        FROM pods GROUP BY namespace""",
)
def f08(spark, sf_dir):
    return containers.namespace_totals(_pods(spark, sf_dir))
