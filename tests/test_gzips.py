"""Gzip files by member: many tasks for one file, lines across members, damage, text that looks like a member."""

import gzip
import random
import zlib

import pytest

from logweave.sources import gzips
from logweave.sources.gzips import gzip_lines, gzip_rejects, index_members


def write(folder, **files):
    out = []
    for name, content in files.items():
        path = folder / f"{name}.gz"
        path.write_bytes(content)
        out.append((f"file://{path}", len(content)))
    return out


def read(spark, files):
    members = index_members(spark.createDataFrame(files, "path string, length long"))
    lines = gzip_lines(members).orderBy("path", "block_start", "line_id").collect()
    texts = {}
    for row in lines:
        texts.setdefault(row.path.rsplit("/", 1)[1].removesuffix(".gz"), []).append(row.value)
    return members, texts, lines


@pytest.fixture
def small(monkeypatch):
    """Ranges, slices and blocks so small that every border is crossed."""
    for name, value in {"RANGE_BYTES": 300, "SLICE_BYTES": 500, "READ_BYTES": 64, "BLOCK_BYTES": 40}.items():
        monkeypatch.setattr(gzips, name, value)


def test_members_are_read_by_many_tasks(spark, tmp_path, small):
    rng = random.Random(4)
    text = "".join(f"line {k} {'x' * rng.randrange(60)}" + rng.choice(["\n", "\n", "\r\n", "\r"]) for k in range(400)) + "no end"
    cuts = [0, *sorted(rng.sample(range(len(text)), 60)), len(text)]
    parts = [text[a:b].encode() for a, b in zip(cuts[:-1], cuts[1:])]
    # one member holds a whole gzip file without compression
    inner = gzip.compress(b"hidden\n" * 3)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = packer.compress(b"before\n" + inner + b"\nafter\n") + packer.flush()
    files = write(tmp_path, many=b"".join(map(gzip.compress, parts)), nested=gzip.compress(b"a\n") + stored + gzip.compress(b"z\n"),
                  one=gzip.compress(text.encode()), empty=gzip.compress(b""), padded=gzip.compress(b"p\n") + bytes(700))
    members, texts, lines = read(spark, files)
    want = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    assert texts["many"] == want and texts["one"] == want and texts["padded"] == ["p"] and "empty" not in texts
    assert texts["nested"][0] == "a" and texts["nested"][-1] == "z" and "before" in texts["nested"] and "hidden" not in texts["nested"]
    assert len({r.block_start for r in lines if r.path.endswith("many.gz")}) > 5
    assert members.filter("path like '%many.gz'").count() == 61 and gzip_rejects(members).count() == 0


def test_text_around_damage_is_kept(spark, tmp_path, small):
    good = [gzip.compress(f"m{k} {'word ' * 30}\n".encode()) for k in range(6)]
    bad = bytearray(gzip.compress("".join(f"broken {k * 7919 % 9973}\n" for k in range(300)).encode()))
    bad[len(bad) // 2 : len(bad) // 2 + 40] = bytes(40)
    files = write(tmp_path, torn=good[0] + gzip.compress(b"last line\nand more\n" * 20)[:-12], holed=good[0] + good[1] + bytes(bad) + good[2] + good[3],
                  none=b"\x1f\x8b", other=b"plain text", fine=b"".join(good))
    members, texts, _ = read(spark, files + [("file:///no/such/file.gz", 10)])
    rejects = {r.path.rsplit("/", 1)[1]: r for r in gzip_rejects(members).collect()}
    assert set(rejects) == {"torn.gz", "holed.gz", "none.gz", "other.gz", "file.gz"}
    assert texts["torn"][0].startswith("m0") and texts["torn"][1:3] == ["last line", "and more"] and rejects["torn.gz"].reason.startswith("EOFError")
    holed = texts["holed"]
    assert [x[:2] for x in holed[:2]] == ["m0", "m1"] and [x[:2] for x in holed[-2:]] == ["m2", "m3"]
    assert holed[2] == "broken 0" and len(holed) > 20
    assert rejects["holed.gz"].bytes_read > 4 * 150 and rejects["file.gz"].bytes_read == 0


def test_no_files(spark):
    members = index_members(spark.createDataFrame([], "path string, length long"))
    assert gzip_lines(members).count() == 0 and gzip_rejects(members).count() == 0
