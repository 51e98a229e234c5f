"""Files of every kind through the whole load, and export back to text."""

import glob
import gzip
import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from logweave.operators.profile import by_application
from logweave.operators.timeline import with_sort_time
from logweave.plans.load import load_logs, store_entries, stored
from logweave.sources.export import export_view, export_views
from logweave.sources.files import is_binary, list_files, read_lines

LINE = "2024-01-01 00:00:{:02d}.000 [t] INFO a.B - {}"


def text(*numbers):
    return "".join(LINE.format(n, f"m{n}") + "\n" for n in numbers)


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder():
    path = tempfile.mkdtemp(prefix="logweave-load-")
    contents = {
        "app.log": text(1, 3).encode(),
        "app.log.1": text(0).encode(),
        "app.log.2.gz": gzip.compress(b"old banner\n" + text(5).encode()),
        "plain.TXT": "nothing known\nhere\n".encode(),
        "noise.log": b"abc\x00def\n",
        "empty.log": b"",
        "skipped.dat": text(9).encode(),
        "broken.zip": b"PK\x03\x04 not a zip",
        "broken.log.gz": gzip.compress(text(7).encode())[:-12],
        "other.7z": b"7z\xbc\xaf'\x1c",
        "bundle.zip": zipped(
            **{
                "logs/web.log": text(2, 4),
                "deep/inner.zip": zipped(**{"in/db.log": "[2024-01-01 00:00:08] WARN low\n  more\n", "x.png": b"\0"}),
                "rot/web.log.1.gz": gzip.compress(text(6).encode()),
                "binary.bin": b"\x00\x01",
                "lib.jar": b"PK",
            }
        ),
    }
    for name, content in contents.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(content)
    os.mkdir(f"{path}/sub")
    with open(f"{path}/sub/hidden.log", "w") as f:
        f.write(text(11))
    return path


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return load_logs(spark, [folder, f"{folder}/app.log.1", f"{folder}/absent.log"])


def test_folder_listing(spark, folder):
    names = {r.name for r in list_files(spark, folder).collect()}
    assert names == {
        "app.log", "app.log.2.gz", "plain.TXT", "noise.log", "broken.zip", "broken.log.gz", "other.7z", "bundle.zip",
    }


def test_loaded_entries(loaded):
    rows = {(r.app, r.source, r.message) for r in loaded.entries.collect()}
    assert rows == {
        ("app", "app.log", "m1"),
        ("app", "app.log", "m3"),
        ("app", "app.log.1", "m0"),
        ("app", "app.log.2.gz", "old banner"),
        ("app", "app.log.2.gz", "m5"),
        # The archive breaks off before the message.
        ("broken", "broken.log", ""),
        ("plain", "plain.TXT", "nothing known"),
        ("plain", "plain.TXT", "here"),
        ("web", "logs/web.log", "m2"),
        ("web", "logs/web.log", "m4"),
        ("web", "rot/web.log.1.gz", "m6"),
        ("db", "in/db.log", "low\n  more"),
    }


def test_rejected_files(loaded):
    reasons = {os.path.basename(r.path): r.reason for r in loaded.rejects.collect()}
    assert set(reasons) == {"broken.zip", "other.7z", "broken.log.gz"}


def test_applications(loaded):
    got = {r.app: (r.entries, r.files, r.title) for r in by_application(loaded.entries).collect()}
    assert got == {
        "app": (5, 3, "app (Auto-Merged)"), "plain": (2, 1, "plain"), "web": (3, 2, "web (Auto-Merged)"), "db": (1, 1, "db"), "broken": (1, 1, "broken"),
    }


def test_store_and_export(spark, loaded):
    out = tempfile.mkdtemp(prefix="logweave-out-")
    parsed = stored(loaded.entries)
    store_entries(with_sort_time(parsed), f"{out}/entries")
    back = spark.read.parquet(f"{out}/entries")
    assert back.count() == parsed.count() == 12
    app = back.filter("app = 'app'")
    export_view(app, f"{out}/one")
    parts = sorted(glob.glob(f"{out}/one/part-*"))
    got = "".join(open(x).read() for x in parts).splitlines()
    assert got == [LINE.format(0, "m0"), LINE.format(1, "m1"), LINE.format(3, "m3"), "old banner", LINE.format(5, "m5")]
    export_views(back.withColumn("view", F.concat(F.lit("my "), "app")), f"{out}/many", compression="gzip")
    again = spark.read.text(f"{out}/many").groupBy("view_file").count().collect()
    assert {(r[0], r[1]) for r in again} == {("my_app.log", 5), ("my_plain.log", 2), ("my_web.log", 3), ("my_db.log", 2), ("my_broken.log", 1)}


def test_missing_paths_give_nothing(spark):
    assert read_lines(spark, ["/nowhere/a.log"]).count() == 0
    assert list_files(spark, "/nowhere").count() == 0


def test_binary_share(spark):
    cases = [
        (b"plain text\r\n\t", False, False),
        (b"nul\x00", True, True),
        (b"\x01" * 3 + b"a" * 7, False, False),
        (b"\x01" * 4 + b"a" * 6, True, True),
        ("Привет мир".encode(), False, True),
        (b"\x01" * 1024 + b"a" * 9000, True, False),
        (b"a" * 1024 + b"\x00", False, False),
        (b"", False, False),
    ]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _, _) in enumerate(cases)], "i int, content binary")
    rows = df.select("i", is_binary(F.col("content")).alias("a"), is_binary(F.col("content"), compat=True).alias("b")).collect()
    assert {r.i: (r.a, r.b) for r in rows} == {i: (a, b) for i, (_, a, b) in enumerate(cases)}


def test_overlapping_and_odd_paths(spark):
    path = tempfile.mkdtemp(prefix="logweave-odd-")
    odd = "a b%20+ü#1.log"
    for name in ("app.log", odd):
        with open(f"{path}/{name}", "w") as f:
            f.write(text(1) + "  more\n" + text(2))
    got = load_logs(spark, [path, f"{path}/app.log", f"{path}/{odd}", path + "/", f"{path}/app.log"]).entries.collect()
    assert sorted((r.source, r.message) for r in got) == sorted(
        (name, m) for name in ("app.log", odd) for m in ("m1\n  more", "m2")
    )


def test_equal_member_names_and_inner_7z(spark):
    path = tempfile.mkdtemp(prefix="logweave-zip-")
    with zipfile.ZipFile(f"{path}/twice.zip", "w") as z:
        z.writestr("same.log", text(1) + "  one\n")
        z.writestr(zipfile.ZipInfo("same.log"), text(2) + "  two\n")
        z.writestr("in.7z", b"7z")
    loaded = load_logs(spark, path)
    assert sorted(r.message for r in loaded.entries.collect()) == ["m1\n  one", "m2\n  two"]
    assert [(os.path.basename(r.path), r.reason) for r in loaded.rejects.collect()] == [("twice.zip!in.7z", "7z is not supported")]


def test_parts_keep_fields_and_count_once(spark, lines_of):
    from logweave.operators.parse import parse_lines
    from logweave.plans.parse_queries import DEFAULT

    body = "2024-01-01 00:00:01.000 [t] ERROR a.B - big\n" + "\n".join(f"  line {k}" for k in range(40))
    lines = lines_of({"app.log": text(0) + body + "\n" + text(2).rstrip()})
    parsed = parse_lines(lines, DEFAULT, chunk_bits=2, max_part_bytes=60).withColumn("app", F.lit("app"))
    rows = parsed.filter("level = 'ERROR'").collect()
    assert len(rows) > 3 and {(r.timestamp, r.thread, r.logger) for r in rows} == {(rows[0].timestamp, "t", "a.B")}
    assert "\n".join(r.raw for r in sorted(rows, key=lambda r: r.part)) == body
    total = by_application(parsed).first()
    assert (total.entries, total.errors) == (3, 1)


def test_searches_see_entries_not_parts(spark, lines_of):
    """An entry above the limit goes on in parts: counts, steps and the newest entry stay as without a limit."""
    from logweave.operators import search, timeline
    from logweave.operators.parse import parse_lines
    from logweave.plans.parse_queries import DEFAULT

    body = "2024-01-01 00:00:01.000 [t] ERROR a.B - big\n" + "\n".join(f"  word {k}" for k in range(20)) + "\n  rare"
    lines = lines_of({"app.log": text(0) + body, "b.log": text(3) + body + "\n" + text(4).rstrip()})
    seen = []
    for limit in (1 << 28, 40):
        entries = stored(parse_lines(lines, DEFAULT, chunk_bits=2, max_part_bytes=limit).withColumn("view", F.col("source")))
        hit = F.contains("raw", F.lit("word"))
        rare = F.contains("raw", F.lit("rare"))
        counts = {m: sorted(tuple(r) for r in search.count_matches(entries, m_).collect()) for m, m_ in (("word", hit), ("rare", rare))}
        one = entries.filter("view = 'b.log'")
        order = ["block_start", "line_id", "part"]
        step = search.find_next(one, rare, order).first()
        again = search.find_next(one, rare, order, cursor=[step.block_start, step.line_id, 0]).collect()
        views = search.find_next_in_views(entries, rare, ["app.log", "b.log"], order, "app.log").first()
        newest = sorted((r.view, r.raw.split("\n")[0], r.part) for r in timeline.newest(entries).collect())
        tail = [r.raw.split("\n")[0] for r in timeline.tail(one, 2, order).collect()]
        seen.append((counts, step.raw.split("\n")[0], again, views.view, newest, tail, search.count_matches(entries, rare, by=None).first()[0]))
    assert seen[0] == seen[1]
    assert seen[0][0] == {"word": [("app.log", 1), ("b.log", 1)], "rare": [("app.log", 1), ("b.log", 1)]} and seen[0][6] == 2


def test_lines_of_many_archives_share_batches():
    """Small archives are not a batch each, long lines do not make a large one, and each archive counts its own lines."""
    from logweave.sources import archives

    rows = [(f"{k}.zip", iter([("a.log", "a.log", io.BytesIO(b"x\ny\n")), ("b.7z", "b.7z", None)])) for k in range(50)]
    frames = list(archives._framed(row for path, members in rows for row in archives._member_rows(path, members)))
    assert len(frames) == 1 and frames[0]["line_id"].tolist() == [0, 1, 2] * 50
    long = [("a", "a", k, "x" * (1 << 20), None) for k in range(20)]
    assert [len(f) for f in archives._framed(iter(long))] == [4] * 5
