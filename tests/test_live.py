"""Live events: batch forms, stream twins and session routing."""

import datetime
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from logweave.plans import live_queries
from logweave.schema import DISCONNECT, as_entries
from logweave.streaming import events, live, ordered, tables
from logweave.streaming.events import frame_xml, read_structured, read_xml
from logweave.streaming.sessions import route_batch, route_with_idle

EVENTS = "remote string, seq long, event_kind string, source string, ip string, port int"
SESSIONS = [
    ("127.0.0.1:12345", 0, "event", "RemoteApp", "127.0.0.1", 12345),
    ("127.0.0.1:12345", 1, "event", "other", "127.0.0.1", 12345),
    ("127.0.0.1:12346", 0, "event", "RemoteApp", "127.0.0.1", 12346),
    ("127.0.0.1:12346", 1, "disconnect", None, None, None),
    ("127.0.0.1:12346", 2, "event", "shop", "127.0.0.1", 12346),
    ("127.0.0.1:12346", 3, "event", "RemoteApp", "127.0.0.1", 12346),
]
ROUTED = {
    ("127.0.0.1:12345", 0, "Remote(127.0.0.1:12345)"),
    ("127.0.0.1:12345", 1, "Remote(127.0.0.1:12345)"),
    ("127.0.0.1:12346", 0, "Remote(127.0.0.1:12346)"),
    ("127.0.0.1:12346", 2, "shop (127.0.0.1)"),
    ("127.0.0.1:12346", 3, "shop (127.0.0.1)"),
}


def run(spark, rows, schema, cuts, make):
    """Feed the rows file by file through a stream and collect its output."""
    folder = tempfile.mkdtemp(prefix="logweave-stream-")
    start = 0
    for i, end in enumerate([*cuts, len(rows)]):
        spark.createDataFrame(rows[start:end], schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        start = end
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    out = make(stream)
    live.append_to(out, f"{folder}/out", f"{folder}/offsets", available_now=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("bits", [0, 1, 16])
def test_sticky_sessions(spark, bits):
    got = route_batch(spark.createDataFrame(SESSIONS, EVENTS), chunk_bits=bits)
    assert {(r.remote, r.seq, r.view) for r in got.collect()} == ROUTED


def test_sticky_sessions_stream(spark):
    live.use_rocksdb(spark)
    got = run(spark, SESSIONS, EVENTS, [1, 3, 4], live.route_stream)
    assert {(r.remote, r.seq, r.view) for r in got.collect()} == ROUTED


XML = [
    '<log4j:event logger="a.B" timestamp="1700000000123" level="WARN" thread="main">',
    "<log4j:message><![CDATA[hello",
    "world]]></log4j:message>",
    "<log4j:throwable><![CDATA[Boom]]></log4j:throwable>",
    "</log4j:event>",
    '<log4j:event thread="t" level="INFO" timestamp="soon" logger="c"><log4j:message><![CDATA[x > y]]></log4j:message></log4j:event>'
    '<log4j:event logger="d" timestamp="5" level="INFO" thread="u"><log4j:message><![CDATA[]]></log4j:message></log4j:event>',
    "noise</log4j:event>",
    "<log4j:event unfinished",
]
XML_ROWS = [(r, i, line, "event") for r in ("p", "q") for i, line in enumerate(XML)]
XML_ROWS += [("p", 10, "", "disconnect"), ("p", 11, "rest</log4j:event>", "event")]
XML_SCHEMA = "remote string, seq long, line string, event_kind string"


def test_xml_events(spark):
    lines = spark.createDataFrame(XML_ROWS, XML_SCHEMA)
    entries = as_entries(read_xml(frame_xml(lines, chunk_bits=1)), "remote", "seq", "event")
    rows = entries.filter("remote = 'q'").orderBy("seq", "event").collect()
    got = [(str(r.timestamp), r.level, r.thread, r.logger, r.message, r.source) for r in rows]
    assert got == [
        ("2023-11-14 22:13:20.123000", "WARN", "main", "a.B", "hello\nworld\nBoom", "RemoteApp"),
        ("None", "INFO", "t", "c", "x > y", "RemoteApp"),
        ("1970-01-01 00:00:00.005000", "INFO", "u", "d", "", "RemoteApp"),
    ]
    assert rows[0].raw == "\n".join(XML[:5]) + "\n"


@pytest.mark.parametrize("cuts", [[], [2, 5, 9]])
def test_xml_frames_stream(spark, cuts):
    live.use_rocksdb(spark)
    want = {tuple(r) for r in frame_xml(spark.createDataFrame(XML_ROWS, XML_SCHEMA)).collect()}
    assert len(want) == 7
    got = run(spark, XML_ROWS, XML_SCHEMA, cuts, live.frame_xml_stream)
    assert {tuple(r) for r in got.collect()} == want


def test_structured_events(spark):
    payloads = [
        ("logback", {"timeStamp": 1000, "level": "INFO", "threadName": "t", "loggerName": "l", "formattedMessage": "m", "mdc": {"application": "shop"}}),
        ("log4j1", {"timeStamp": 1001, "level": "WARN", "threadName": "t", "loggerName": "l", "renderedMessage": "m", "mdc": {"application": ""}, "throwable": ["a", "b"]}),
        ("log4j2", {"timeMillis": 1002, "level": "ERROR", "threadName": "t", "loggerName": "l", "message": "m", "thrown": "x\ny"}),
        ("other", {"message": "m"}),
    ]
    rows = [(f, json.dumps(p)) for f, p in payloads] + [("logback", "{broken")]
    df = read_structured(spark.createDataFrame(rows, "family string, payload string"))
    got = {(r.family, str(r.timestamp), r.level, r.message, r.source) for r in df.collect()}
    assert got == {
        ("logback", "1970-01-01 00:00:01", "INFO", "m", "shop"),
        ("log4j1", "1970-01-01 00:00:01.001000", "WARN", "m\na\nb", "RemoteApp"),
        ("log4j2", "1970-01-01 00:00:01.002000", "ERROR", "m\nx\ny", "RemoteApp"),
    }
    berlin = read_structured(spark.createDataFrame(rows[:1], "family string, payload string"), zone="Europe/Berlin")
    assert str(berlin.first().timestamp) == "1970-01-01 01:00:01"


def test_what_cannot_be_read_has_a_reason(spark):
    rows = [
        (1, "logback", '{"formattedMessage": "ok"}'), (2, "log4j9", "{}"), (3, None, '{"message": "x"}'), (4, "log4j2", None),
        (5, "log4j2", '{"message": "cut'), (6, "log4j1", '{"message": "of another family"}'), (7, "log4j1", ""),
    ]
    df = spark.createDataFrame(rows, "id int, family string, payload string")
    tagged = {r.id: (r.reason, r.raw) for r in events.tagged_structured(df).collect()}
    no_json, unknown = events.NO_JSON, events.UNKNOWN_FAMILY
    reasons = [None, unknown, unknown, no_json, no_json, events.NO_MESSAGE, no_json]
    assert [tagged[i + 1][0] for i in range(7)] == reasons
    assert [tagged[i][1] for i in (1, 2, 5)] == ["ok", "{}", '{"message": "cut']
    assert [r.id for r in read_structured(df).collect()] == [1]

    good, end = '<log4j:event level="INFO"><log4j:message><![CDATA[m]]></log4j:message>', "</log4j:event>"
    frames = [("a", good + end), ("b", "no tag " + end), ("c", None), ("d", good + end + good + end), ("e", f"{end}{end}")]
    df = spark.createDataFrame(frames, "remote string, xml string")
    tagged = events.tagged_xml(df).collect()
    assert {r.remote: r.raw for r in tagged if r.reason} == {"b": frames[1][1], "c": None, "e": frames[4][1]}
    assert sorted((r.remote, r.reason is None) for r in tagged) == [("a", True), ("b", False), ("c", False), ("d", True), ("d", True), ("e", False)]
    assert sorted(r.remote for r in read_xml(df).collect()) == ["a", "d", "d"]


def test_running_facets(spark):
    rows = [("INFO", "a.t1", "x.L", "ip", "m", "s")] * 3 + [("WARN", "t2(z)", "x.L", "", "m", "s")]
    schema = "level string, thread string, logger string, ip string, message string, source string"
    folder = tempfile.mkdtemp(prefix="logweave-facets-")
    for i in (0, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").json(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    tables.follow_facets(stream, f"{folder}/table", f"{folder}/offsets", available_now=True).awaitTermination()
    got = tables.facets_table(spark, f"{folder}/table").current().collect()
    assert {tuple(r) for r in got} == {
        ("level", "INFO", 3), ("level", "WARN", 1), ("thread", "t1", 3), ("thread", "t2", 1), ("logger", "L", 4), ("ip", "ip", 3), ("source", "s", 4),
    }
    assert len(got) == 7


def test_table_of_newest_rows(spark, tmp_path, monkeypatch):
    """Whole versions, repeated batches and keys that lose rows."""
    monkeypatch.setattr(tables, "FOLD", 2)
    table = tables.LatestTable(spark, str(tmp_path / "t"), ["k"], "k string, v int")
    assert table.current().count() == 0

    def put(version, rows):
        table.replace(spark.createDataFrame(rows, "k string, v int"), version)
        return sorted(tuple(r) for r in table.current().collect())

    assert put(0, [("a", 1), ("a", 2), ("b", 3)]) == [("a", 1), ("a", 2), ("b", 3)]
    assert put(1, [("a", 5)]) == [("a", 5), ("b", 3)]
    assert put(2, [("c", 7)]) == [("a", 5), ("b", 3), ("c", 7)]
    assert put(2, [("c", 8)]) == [("a", 5), ("b", 3), ("c", 8)]
    assert put(3, []) == [("a", 5), ("b", 3), ("c", 8)]
    assert put(4, [("b", 0)]) == [("a", 5), ("b", 0), ("c", 8)]


def test_followed_tail(spark, tmp_path):
    rows = [("v" if i % 3 else "w", (i * 37) % 101) for i in range(60)]
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], "view string, at int").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("view string, at int").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    tables.follow_tail(stream, 4, ["at"], f"{tmp_path}/t", f"{tmp_path}/o", available_now=True).awaitTermination()
    got = sorted(tuple(r) for r in tables.tail_table(stream, f"{tmp_path}/t").current().collect())
    assert got == sorted((v, a) for w in "vw" for v, a in sorted((r for r in rows if r[0] == w), key=lambda r: r[1])[-4:])
    assert spark.read.parquet(f"{tmp_path}/t").groupBy("version", "view").count().agg(F.max("count")).first()[0] == 4


IDLE_EVENTS = "remote string, seq long, event_kind string, source string, ip string, port int, ts timestamp"


def at(second):
    return datetime.datetime.fromtimestamp(1_700_000_000 + second)


def idle_rows():
    """Connections with gaps, a disconnect and times that repeat, as (arrival, row)."""
    rows = []
    for k, remote in enumerate(("p", "q", "r")):
        second = 0
        for seq in range(30):
            second += [5, 0, 40, 61, 60, 200][(seq * 7 + k) % 6]
            gone = seq % 11 == 7
            kind, source = (DISCONNECT, None) if gone else ("event", "RemoteApp" if seq % 4 == 0 else f"app{seq}")
            row = (remote, seq, kind, source, None if gone else "ip", None if gone or seq % 4 else 9000 + k, at(second))
            rows.append((second + (seq * 13) % 29, row))
    return rows


def plain_routes(rows, idle):
    out = []
    for remote in sorted({x[0] for x in rows}):
        view = last = None
        for x in sorted((x for x in rows if x[0] == remote), key=lambda x: (x[6], x[1])):
            if last is not None and (x[6] - last).total_seconds() > idle:
                view = None
            last = x[6]
            if x[2] == DISCONNECT:
                view = None
                continue
            view = view or (f"Remote({x[4]}:{x[5]})" if x[3] == "RemoteApp" else f"{x[3]} ({x[4]})")
            out.append((remote, x[1], view))
    return out


def test_silence_ends_a_session(spark):
    rows = [x for _, x in idle_rows()]
    got = route_with_idle(spark.createDataFrame(rows, IDLE_EVENTS).repartition(3), 60)
    assert sorted(tuple(x) for x in got.select("remote", "seq", "view").collect()) == plain_routes(rows, 60)


def test_late_events_stand_in_their_place_and_state_ends(spark, tmp_path):
    """Events that are out of order over several micro-batches, then one that comes too late."""
    live.use_rocksdb(spark)
    dealt = sorted(idle_rows())
    end = [("end", 0, DISCONNECT, None, None, None, at(100_000))]
    late = [("p", 99, "event", "too late", "ip", 1, at(3))]
    batches = [[x for _, x in dealt[k : k + 15]] for k in range(0, len(dealt), 15)] + [end, late]
    for rows in batches:
        spark.createDataFrame(rows, IDLE_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(IDLE_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ordered.route_in_order(stream, idle_seconds=60, delay_seconds=30)
    run_ = live.append_to(out, f"{tmp_path}/out", f"{tmp_path}/offsets", available_now=True)
    run_.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(tuple(x) for x in got) == plain_routes([x for _, x in dealt], 60)
    # All three connections have fallen silent: what is left in state belongs to the last row alone.
    state = spark.read.format("statestore").option("stateVarName", "view").load(f"{tmp_path}/offsets")
    assert state.count() == 0
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/offsets")
    assert {x.key.remote for x in waiting.select("key").collect()} <= {"end"}


def test_frames_of_lines_out_of_order(spark, tmp_path):
    live.use_rocksdb(spark)
    lines = [(r, seq, line, kind, at(seq // 2)) for r, seq, line, kind in XML_ROWS]
    schema = f"{XML_SCHEMA}, ts timestamp"
    dealt = sorted(lines, key=lambda x: (x[1] * 7) % 12)
    for k in (0, 6, 12):
        spark.createDataFrame(dealt[k : k + 6] if k < 12 else dealt[12:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", 0, "", DISCONNECT, at(9000))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ordered.frame_in_order(stream, idle_seconds=600, delay_seconds=100)
    live.append_to(out, f"{tmp_path}/out", f"{tmp_path}/offsets", available_now=True).awaitTermination()
    got = {tuple(x) for x in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(x) for x in frame_xml(spark.createDataFrame(XML_ROWS, XML_SCHEMA)).collect()}


def test_connections_share_the_state_of_a_bucket(spark, tmp_path):
    """Many connections, also one without a name, in few groups: the rows of the plain routes, and a state of few keys."""
    live.use_rocksdb(spark)
    rows = [(f"{x[0]}{c}" if c else None, *x[1:]) for c in range(20) for _, x in idle_rows() if c or x[0] == "p"]
    rows.sort(key=lambda x: (x[-1].timestamp() // 25, str(x[0]), -x[1]))
    end = [("end", 0, DISCONNECT, None, None, None, at(100_000))]
    for part in (rows[0::2], rows[1::2], end):
        spark.createDataFrame(part, IDLE_EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(IDLE_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ordered.route_in_order(stream, idle_seconds=60, delay_seconds=50_000, buckets=3)
    live.append_to(out, f"{tmp_path}/out", f"{tmp_path}/offsets", available_now=True).awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    want = plain_routes([(x[0] or "", *x[1:]) for x in rows], 60)
    assert sorted((x.remote or "", x.seq, x.view) for x in got) == want
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/offsets")
    assert waiting.select("key").distinct().count() <= 3


def test_micro_batches_of_several_files(spark):
    """Each micro-batch takes the same number of files, also where a part of the events is too small to fill them."""
    rows = spark.createDataFrame([(f"r{k % 7}", k, at(k * k * 50)) for k in range(300)], "remote string, seq long, ts timestamp")
    end = spark.createDataFrame([("end", 0, at(10_000_000))], rows.schema)
    stream = live_queries.delivered(rows, "late", end, file_rows=10)
    path = live_queries.scratch_path(spark, "copy")
    batches = []
    run = stream.writeStream.foreachBatch(lambda df, k: batches.append(sorted(r.seq for r in df.collect())))
    run.option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == live_queries.BATCHES and sorted(x for b in batches for x in b) == sorted([*range(300), 0])


def test_state_has_a_time_to_live(spark, tmp_path):
    """A connection that was silent for the time to live is forgotten: its next event opens a view anew."""
    live.use_rocksdb(spark)
    rows = [("c", 0, "event", "first", "ip", 1), ("c", 1, "event", "second", "ip", 1), ("c", 2, "event", "third", "ip", 1)]

    def views(ttl, name):
        folder = f"{tmp_path}/{name}"
        for k in (0, 1):
            part = rows[:2] if k == 0 else rows[2:]
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(f"{folder}/in")
            out = live.route_stream(spark.readStream.schema(EVENTS).json(f"{folder}/in"), ttl_ms=ttl)
            writer = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/offsets")
            assert writer.trigger(once=True).start(f"{folder}/out").awaitTermination(60)
        return sorted(tuple(x)[1:] for x in spark.read.parquet(f"{folder}/out").collect())

    assert views(1, "short") == [(0, "first (ip)"), (1, "first (ip)"), (2, "third (ip)")]
    assert views(3_600_000, "long") == [(k, "first (ip)") for k in range(3)]
