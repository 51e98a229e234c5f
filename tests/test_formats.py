"""Known log snippets through detection, parsing and stitching."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from logweave.operators.detect import parse_detected
from logweave.operators.formats import ColumnFormat, FormatSet, Layout, Mixed, RegexFormat, default_formats
from logweave.operators.parse import flag_starts, parse_lines, read_lines

BASE = "2024-06-15"


def at(text):
    return dt.datetime.fromisoformat(text)


CASES = {
    "default.log": (
        "2023-10-27 10:00:00.123 [main] INFO  de.shop.Main - App started\n"
        "2023-10-27 10:00:01.456 [thread-1] ERROR de.shop.App - Something failed\n"
        "java.lang.RuntimeException: foo",
        [
            (at("2023-10-27 10:00:00.123"), "INFO", "main", "de.shop.Main", "", "App started"),
            (
                at("2023-10-27 10:00:01.456"), "ERROR", "thread-1", "de.shop.App", "",
                "Something failed\njava.lang.RuntimeException: foo",
            ),
        ],
    ),
    "bracket.log": (
        "[2023-10-27 10:00:00] INFO This is a test message\n[2023-10-27 10:00:01] ERROR Another",
        [
            (at("2023-10-27 10:00:00"), "INFO", "", "", "", "This is a test message"),
            (at("2023-10-27 10:00:01"), "ERROR", "", "", "", "Another"),
        ],
    ),
    "banner.log": (
        "  ____\n / banner\n\n2023-10-27 10:00:00,808 INFO [io.quarkus] (main) started\n  more\n"
        "2023-10-27 10:00:01,000 WARN [org.x] (worker-1) slow",
        [
            (None, "", "", "", "", "  ____\n / banner\n"),
            (at("2023-10-27 10:00:00.808"), "INFO", "main", "io.quarkus", "", "started\n  more"),
            (at("2023-10-27 10:00:01"), "WARN", "worker-1", "org.x", "", "slow"),
        ],
    ),
    "database.log": (
        "2025-12-25 08:00:00,808 INFO: no action\n2025-12-25 08:00:01.592 UTC [25] LOG checkpoint\n\tdetail\n"
        "2025-12-25 08:00:02,806 INFO: done",
        [
            (at("2025-12-25 08:00:00.808"), "INFO", "", "", "", "no action"),
            (at("2025-12-25 08:00:01.592"), "LOG", "25", "", "", "checkpoint\n\tdetail"),
            (at("2025-12-25 08:00:02.806"), "INFO", "", "", "", "done"),
        ],
    ),
    "internal.log": (
        "10:31:39,416 |-INFO in ch.Config - found\n10:31:39,500 |-INFO in ch.Other - two\n10:31:40,001 |-WARN in ch.Other - odd",
        [
            (at(f"{BASE} 10:31:39.416"), "INFO", "", "ch.Config", "", "found"),
            (at(f"{BASE} 10:31:39.500"), "INFO", "", "ch.Other", "", "two"),
            (at(f"{BASE} 10:31:40.001"), "WARN", "", "ch.Other", "", "odd"),
        ],
    ),
    "condensed.log": (
        "header one\nheader two\n10:31:50.633 INFO a.b.App - Started\n  tail\n10:31:51.000 WARN a.b.App - x",
        [
            (None, "", "", "", "", "header one\nheader two"),
            (at(f"{BASE} 10:31:50.633"), "INFO", "", "a.b.App", "", "Started\n  tail"),
            (at(f"{BASE} 10:31:51"), "WARN", "", "a.b.App", "", "x"),
        ],
    ),
    "threaded.log": (
        "09:00:40.743 [restartedMain] INFO  com.shop.Services - ready\tServices.java",
        [(at(f"{BASE} 09:00:40.743"), "INFO", "restartedMain", "com.shop.Services", "", "ready\tServices.java")],
    ),
    "proxy.log": (
        "2025-12-25T08:59:40.206963Z\tinfo\tcert ready\tcache.go\n2025-12-25T08:59:41.000001Z\twarn\tno trailing field",
        [
            (at("2025-12-25 08:59:40.206963"), "info", "", "cache.go", "", "cert ready"),
            (at("2025-12-25 08:59:41.000001"), "warn", "", "", "", "no trailing field"),
        ],
    ),
    "service.log": (
        "2025-12-25T08:59:40.206Z  INFO 1 --- [shop] [main] c.s.App : hello\n"
        "2025-12-25T08:59:41.206Z  INFO 1 --- [main] c.s.App : bye",
        [
            (at("2025-12-25 08:59:40.206"), "INFO", "shop", "c.s.App", "", "hello"),
            (at("2025-12-25 08:59:41.206"), "INFO", "main", "c.s.App", "", "bye"),
        ],
    ),
    "levelfirst.log": (
        "ERROR 2023-01-19 09:39:29.590 [Deploy] Server: failed\n a\n b\n c\nINFO 2023-01-19 09:39:30.000 [Deploy] Server: ok",
        [
            (at("2023-01-19 09:39:29.590"), "ERROR", "Deploy", "Server", "", "failed\n a\n b\n c"),
            (at("2023-01-19 09:39:30"), "INFO", "Deploy", "Server", "", "ok"),
        ],
    ),
    "access.log": (
        '127.0.0.6 - - [06/Jan/2026:11:02:42 +0000] "GET / HTTP/1.1" 200 5\n127.0.0.7 - - [06/Jan/2026:11:02:43 -0900] "GET /x"',
        [
            (at("2026-01-06 11:02:42"), "", "", "", "127.0.0.6", '"GET / HTTP/1.1" 200 5'),
            (at("2026-01-06 11:02:43"), "", "", "", "127.0.0.7", '"GET /x"'),
        ],
    ),
    "raw.log": ("just text\nno format", [(None, "", "", "", "", "just text"), (None, "", "", "", "", "no format")]),
    "plain.log": (
        "2023-10-27 10:00:00 : one\n2023-13-27 10:00:00 : bad month\n2023-10-27 10:00:02 : two",
        [
            (at("2023-10-27 10:00:00"), "", "", "", "", "one\n2023-13-27 10:00:00 : bad month"),
            (at("2023-10-27 10:00:02"), "", "", "", "", "two"),
        ],
    ),
}


@pytest.fixture(scope="module")
def parsed(lines_of):
    texts = {name: text for name, (text, _) in CASES.items()}
    rows = parse_detected(lines_of(texts), base_date=BASE).orderBy("source", "block_start", "line_id").collect()
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append((r.timestamp, r.level, r.thread, r.logger, r.ip, r.message))
    return out


@pytest.mark.parametrize("name", CASES)
def test_known_logs(parsed, name):
    assert parsed[name] == CASES[name][1]


def test_raw_text_is_whole(lines_of):
    texts = {name: text for name, (text, _) in CASES.items()}
    rows = parse_detected(lines_of(texts), base_date=BASE).orderBy("source", "block_start", "line_id").collect()
    for name, text in texts.items():
        assert "\n".join(r.raw for r in rows if r.source == name) == text


def read(spark, fmt, *lines, **kw):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return [r.fields for r in read_lines(df, fmt, base_date=BASE, **kw).orderBy("i").collect()]


def test_custom_layout(spark):
    (got,) = read(spark, Layout("%d{dd.MM.yyyy HH:mm} %level %msg"), "27.10.2023 10:00 DEBUG Processed item 5")
    assert (got.timestamp, got.level, got.message) == (at("2023-10-27 10:00"), "DEBUG", "Processed item 5")


def test_time_corner_cases(spark):
    fmt = Layout("%d{yyyy-MM-dd HH:mm:ss} | %msg")
    got = read(
        spark, fmt,
        "2023-02-31 10:00:00 | short month", "2023-02-32 10:00:00 | no day", "2023-04-05 24:00:00 | midnight",
        "2023-04-05 24:00:01 | no", "2023-4-05 10:00:00 | one digit",
    )
    stamps = [g and g.timestamp for g in got]
    assert stamps == [at("2023-02-28 10:00"), None, at("2023-04-06"), None, None]


def test_weekday_must_agree(spark):
    fmt = Layout("%d{EEE'/'dd MMM yyyy HH:mm:ss z}> %msg")
    got = read(spark, fmt, "Fri/05 Jan 2024 10:00:00 CET> a", "Thu/05 Jan 2024 10:00:00 CET> b", "Fri/05 jan 2024 10:00:00 CET> c")
    assert [g and g.timestamp for g in got] == [at("2024-01-05 10:00"), None, None]


def test_month_without_year(spark):
    fmt = Layout("[%d{MMdd/HHmmss.SSS}:%level:%logger] %msg%n")
    line = "[0229/235959.123:ERROR:gpu.cc(42)] lost"
    (got,) = read(spark, fmt, line)
    assert (got.timestamp, got.logger) == (at(f"{BASE} 23:59:59.123"), "gpu.cc(42)")
    (got,) = read(spark, fmt, line, base_year=2024)
    assert got.timestamp == at("2024-02-29 23:59:59.123")


def test_date_only_never_starts(spark):
    assert read(spark, Layout("%d{yyyy-MM-dd} %msg"), "2024-01-01 hello") == [None]


def test_layout_without_time_or_message(spark):
    (got,) = read(spark, Layout("%level: %logger;"), "INFO: a.b;")
    assert (got.timestamp, got.level, got.logger, got.message) == (None, "INFO", "a.b", "INFO: a.b;")


def test_separator_character_in_line(spark):
    fmt = Layout("%d{yyyy-MM-dd HH:mm:ss} [%t] %level - %msg")
    (got,) = read(spark, fmt, "2024-01-01 00:00:00 [a\x01b] INFO - m\x01\x01n")
    assert (got.thread, got.level, got.message) == ("a\x01b", "INFO", "m\x01\x01n")


@pytest.mark.parametrize("bad", ["%d %msg", "%x %msg", "%-5t %msg", "%threads %msg"])
def test_unknown_layout_fields(bad):
    with pytest.raises(ValueError):
        Layout(bad)


def test_layout_literals(spark):
    (got,) = read(spark, Layout("%config%level 100%% (%thread)  $%msg"), "INFO 100% (main) $x")
    assert (got.level, got.thread, got.message) == ("INFO", "main", "x")


def test_group_number_is_checked():
    with pytest.raises(ValueError):
        RegexFormat("x", ".*", r"(\d+) \((a|b)\)", "HH:mm", level=3)


def test_regex_found_inside_line(spark):
    fmt = RegexFormat("inner", ".*", r"<(\d{2}:\d{2}) (\w+)>", "HH:mm", level=2)
    got = read(spark, fmt, "xx <10:20 warn> yy", "none", "<99:00 a> <10:00 b>")
    assert (got[0].timestamp, got[0].level, got[0].message) == (at(f"{BASE} 10:20"), "warn", "")
    assert got[1:] == [None, None]


def test_first_fitting_layout_wins(spark):
    fmt = Mixed("m", ["%d{HH:mm:ss} %msg", "%d{HH:mm} %level %msg"])
    got = read(spark, fmt, "10:00:01 a b", "10:00 INFO b")
    assert [(g.level, g.message) for g in got] == [("", "a b"), ("INFO", "b")]


def test_column_format_in_a_set(spark, lines_of):
    pipe = ColumnFormat(
        "pipe",
        lambda line: line.rlike(r"\A\d+\|"),
        lambda line: F.when(
            line.rlike(r"\A\d+\|"),
            F.struct(
                F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), F.lit("L").alias("level"),
                F.lit("").alias("thread"), F.lit("").alias("logger"), F.lit("").alias("ip"),
                F.substring_index(line, "|", -1).alias("message"),
            ),
        ),
    )
    lines = lines_of({"a": "1|one\nmore\n2|two", "b": "10:00:00.000 [t] INFO  x - y"})
    rows = parse_detected(lines, [*default_formats(), pipe], base_date=BASE).orderBy("source", "line_id").collect()
    assert [(r.source, r.format_index, r.message) for r in rows] == [("a", 19, "one\nmore"), ("a", 19, "two"), ("b", 10, "y")]


def test_filter_on_parsed_fields_keeps_the_plan_small(lines_of):
    df = parse_lines(lines_of({"a": CASES["default.log"][0]}), Layout("%d{yyyy-MM-dd HH:mm:ss.SSS} [%t] %-5level %logger{36} - %msg%n"))
    kept = df.filter(F.col("timestamp") > F.lit("2023-10-27 10:00:01").cast("timestamp_ntz")).filter("level = 'ERROR'")
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert kept.count() == 1


def test_ambiguous_lazy_time_stays_unread(spark):
    line = "Fri, 05 Jan 2024 10:00:00 CET INFO shop.App > hello"
    assert read(spark, default_formats()[8], line) == [None]


def test_index_lookup_equals_single_format(spark):
    lines = {
        0: "2023-10-27 10:00:00,808 INFO [io.q] (main) a", 6: "[0101/101010.123:INFO:x] a",
        16: "2025-12-25 08:00:01.592 UTC [25] LOG checkpoint", 17: "h - - [06/Jan/2026:11:02:42 +0000] m",
    }
    formats = default_formats()
    df = spark.createDataFrame([(i, v) for i, v in lines.items()], "i int, value string")
    by_index = {r.i: r.fields for r in read_lines(df, FormatSet(formats, F.col("i")), base_date=BASE).collect()}
    for i, v in lines.items():
        assert by_index[i] == read(spark, formats[i], v)[0]
        assert by_index[i].timestamp is not None


MANY = [
    (0, "2023-10-27 10:00:00,808 INFO [io.q] (main) a"), (1, "2023-10-27 10:00:00.123 [main] INFO  de.shop.Main - started"),
    (1, "2023-10-27 10:00:00.123 [ma\x01in] INFO  de.shop.Main - sta\x01rted"), (1, "no start"), (1, None),
    (16, "2025-12-25 08:00:01.592 UTC [25] LOG checkpoint"), (16, "2025-12-25 08:00:01,592 LOG: checkpoint"), (-1, "any"),
]


@pytest.mark.parametrize("used", [[1, -1], [0, 1], [16], [-1], []])
def test_formats_that_come_read_as_all_formats_do(spark, used):
    formats = default_formats()
    df = spark.createDataFrame([(n, i, v) for n, (i, v) in enumerate(MANY) if i in used], "n int, i int, value string")

    def both(*known):
        fmt = FormatSet(formats, F.col("i"), *known)
        return sorted((r.n, r.is_start, r.fields) for r in flag_starts(read_lines(df, fmt, base_date=BASE), fmt, base_date=BASE).collect())

    assert both(used) == both()


@pytest.mark.parametrize("used", [[1, -1], [0, 1, 5]])
def test_reading_few_formats_is_compiled(spark, capsys, used):
    """The JVM leaves methods of more than 8000 bytes uncompiled; the look-up of all formats made longer ones."""
    df = spark.createDataFrame([(i, v) for i, v in MANY if i in used], "i int, value string").withColumn("base_date", F.current_date())
    for read_with in (flag_starts, read_lines):
        read_with(df, FormatSet(default_formats(), F.col("i"), used)).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000
