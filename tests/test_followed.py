"""One source for plain, gzip and zip files, read as a whole and followed while the files grow."""

import gzip
import random
import zipfile

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.sources import followed
from logweave.sources.files import read_lines
from logweave.sources.gzips import _Window


def _lines(path, cuts, closed):
    """Lines of a file read in ranges that end at ``cuts``."""
    out = []
    with pafs.LocalFileSystem().open_input_file(str(path)) as raw:
        file = _Window(raw)
        for low, high in zip([0, *cuts], cuts):
            for place, text in followed._range_text(file, low, high, closed and high == cuts[-1]):
                values, starts = followed._split(text)
                out += [(place + int(s), v) for s, v in zip(starts, values)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(b"\n\rab"[x % 4] for x in b)), st.lists(st.integers(0, 60)), st.booleans())
def test_ranges_give_each_line_once(tmp_path_factory, data, cuts, closed):
    """At any cut into ranges the lines, and their places, are those of the whole file."""
    path = tmp_path_factory.mktemp("cut") / "a.log"
    path.write_bytes(data)
    whole = data if closed else data[: data.rfind(b"\n") + 1]
    want, at = [], 0
    for piece in whole.replace(b"\r\n", b"\x00\n").replace(b"\r", b"\n").replace(b"\x00\n", b"\r\n").splitlines(keepends=True):
        want.append((at, piece.rstrip(b"\r\n")))
        at += len(piece)
    cuts = sorted({c for c in cuts if 0 < c < len(data)} | {len(data)})
    assert _lines(path, cuts, closed) == want


def test_small_blocks_and_far_line_starts(tmp_path, monkeypatch):
    monkeypatch.setattr(followed, "READ_BYTES", 7)
    monkeypatch.setattr(followed, "BACK_BYTES", 3)
    test_ranges = [b"x" * 50, b"", b"short", b"y" * 20]
    (tmp_path / "a.log").write_bytes(b"\n".join(test_ranges))
    assert [v for _, v in _lines(tmp_path / "a.log", [5, 11, 30, 52, 60, 78], True)] == test_ranges


def _values(rows):
    return sorted((r.source, r.value) for r in rows.collect())


def _folder(path):
    path.mkdir()
    (path / "a b%20+.log").write_bytes("eins\nzwei ä\r\n\nvier".encode() + b"\xff")
    (path / "other.dat").write_text("no log name")
    (path / ".hidden.log").write_text("hidden")
    (path / "empty.log").write_text("")
    (path / "p.log.gz").write_bytes(gzip.compress(b"g1\ng") + gzip.compress(b"2\n"))
    return path


def test_scan_equals_the_text_scan(spark, tmp_path):
    folder = _folder(tmp_path / "in")
    paths = [str(folder), f"{folder}/", f"{folder}/p.log.gz", f"{folder}/other.dat", f"{folder}/none"]
    columns = ["source_path", "source", "value"]
    want = read_lines(spark, paths).select(*columns)
    for size in (3, 1000):
        got = followed.readable(followed.scan_lines(spark, paths, size)).select(*columns)
        assert sorted(got.collect()) == sorted(want.collect())


def test_range_size_does_not_change_keys(spark, tmp_path):
    folder = _folder(tmp_path / "in")
    keys = [followed.scan_lines(spark, str(folder), n).select("source_path", "block_start", "line_id", "value") for n in (1, 5, 1 << 20)]
    first, *others = [sorted(k.collect()) for k in keys]
    assert all(o == first for o in others)
    assert followed.scan_lines(spark, str(tmp_path / "none")).count() == 0


def test_zip_and_damage_have_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.log", "a\nb\n")
        z.writestr("x.7z", b"7z")
    whole = gzip.compress(b"kept\n")
    (tmp_path / "d.log.gz").write_bytes(whole + whole[:10])
    (tmp_path / "bad.zip").write_bytes(b"PK no zip")
    rows = followed.scan_lines(spark, str(tmp_path))
    assert _values(followed.readable(rows)) == [("d.log", "kept"), ("in.log", "a"), ("in.log", "b")]
    lost = {r.path.rsplit("/", 1)[-1]: (r.reason, r.bytes_read) for r in followed.unreadable(rows).collect()}
    assert set(lost) == {"z.zip!x.7z", "d.log.gz", "bad.zip"}
    assert lost["d.log.gz"][1] == 5


def _look(spark, folder, out, checkpoint, size=16):
    query = followed.follow_lines(spark, str(folder), size).writeStream.format("parquet").option("checkpointLocation", str(checkpoint))
    query.trigger(availableNow=True).start(str(out)).awaitTermination()
    return spark.read.parquet(str(out))


def test_appended_lines_arrive_once(spark, tmp_path):
    """Files grow by any number of bytes between looks; every query starts anew from its checkpoint."""
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(3)
    texts = {f"s{k}.log": "".join(f"{k} line {i} {'x' * rng.randrange(40)}\n" for i in range(12)).encode() for k in range(3)}
    done = dict.fromkeys(texts, 0)
    for look in range(4):
        for name, text in texts.items():
            upto = len(text) if look == 3 else rng.randrange(done[name], len(text))
            with open(folder / name, "ab") as f:
                f.write(text[done[name] : upto])
            done[name] = upto
        with open(folder / "p.log.gz", "ab") as f:
            f.write(gzip.compress(b"member %d\n" % look))
        rows = _look(spark, folder, tmp_path / "out", tmp_path / "offsets")
        want = [(n, v) for n, t in texts.items() for v in t[: done[n]].decode().split("\n")[:-1]]
        want += [("p.log", f"member {i}") for i in range(look + 1)]
        assert _values(followed.readable(rows)) == sorted(want)
    again = _look(spark, folder, tmp_path / "out", tmp_path / "offsets")
    assert again.count() == len(want)
    keys = followed.readable(followed.scan_lines(spark, str(folder)).filter("source <> 'p.log'")).select("source_path", "line_id", "value")
    assert sorted(keys.collect()) == sorted(again.filter("source <> 'p.log'").select("source_path", "line_id", "value").collect())


def test_shorter_file_is_read_anew_and_reported(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nthree\n")
    assert _look(spark, folder, tmp_path / "out", tmp_path / "offsets").count() == 3
    (folder / "a.log").write_text("new\n")
    rows = _look(spark, folder, tmp_path / "out", tmp_path / "offsets")
    assert _values(followed.readable(rows)) == [("a.log", v) for v in ("new", "one", "three", "two")]
    assert [r.reason for r in followed.unreadable(rows).collect()] == [followed.SHORTER]


@pytest.mark.parametrize("name,want", [("a.log.gz", "a.log"), ("a.gz", "a.gz"), ("a%20b.log", "a b.log"), ("x.txt.GZ", "x.txt")])
def test_display_names(name, want):
    assert followed._source(f"file:///logs/{name}") == want


def test_many_small_ranges_share_tasks(tmp_path, monkeypatch):
    """The tasks stay few however many ranges there are, each range is read once, and large ranges keep a task of their own."""
    monkeypatch.setattr(followed, "TASKS", 10)
    parts = [r for k in range(7) for r in followed.ranges(f"{k}.log", 0, 1000 + k, 16)]
    dealt = followed.shared(parts)
    assert [r for t in dealt for r in t.parts] == parts and len(dealt) <= 25
    assert len(followed.shared(parts[:10])) == 10
    large = [followed.Range("a", 0, followed.RANGE_BYTES)] * 30
    assert [t.parts for t in followed.shared(large)] == [[r] for r in large]
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"line {k}" for k in range(500)]
    (folder / "long.log").write_text("\n".join(lines))
    reader = followed._Whole([f"file:{folder}"], 16)
    tasks = [p for p in reader.partitions() if any(r.path.endswith("long.log") for r in p.parts)]
    assert len(tasks) <= 25
    got = [v for p in tasks for b in reader.read(p) for n, v in zip(b["source"].to_pylist(), b["value"].to_pylist()) if n == "long.log"]
    assert got == lines
