"""Stitching gives the same entries wherever chunks and file blocks are cut."""

import random
import tempfile

import pytest

from logweave.operators.formats import Layout
from logweave.operators.parse import parse_lines
from logweave.operators.stitch import stitch
from logweave.sources.files import read_lines


def brute(rows):
    """Entries of one source as lists of lines; the first may be a header."""
    out, headed = [], False
    for line, start in rows:
        if start or not out:
            out.append([line])
            headed = headed or start
        else:
            out[-1].append(line)
    return ["\n".join(x) for x in out]


@pytest.mark.parametrize("bits", [0, 1, 2, 5, 16])
def test_random_sources(spark, bits):
    rng = random.Random(bits)
    rows, want = [], {}
    for s in range(6):
        lines = [(f"{s}-{i}" if rng.random() < 0.9 else "", rng.random() < [0.0, 0.1, 0.5, 0.9, 1.0, 0.3][s]) for i in range(40)]
        want[f"s{s}"] = brute(lines)
        # file blocks of uneven size; line ids only grow inside a block
        cut = sorted(rng.sample(range(1, 40), 3))
        for i, (line, start) in enumerate(lines):
            block = sum(i >= c for c in cut)
            rows.append((f"s{s}", f"s{s}", block * 1000, (7 - block) * 10_000 + i, line, start))
    schema = "source_path string, source string, block_start long, line_id long, value string, is_start boolean"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = {}
    for r in stitch(df, chunk_bits=bits).orderBy("source", "block_start", "line_id").collect():
        got.setdefault(r.source, []).append(r.raw)
        assert r.part == 0
    assert got == want


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_closing_flags(spark, bits):
    rng = random.Random(bits)
    flags = [rng.random() < 0.3 for _ in range(50)]
    rows = [("p", 0, i, str(i), f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "source_path string, block_start long, line_id long, value string, is_start boolean")
    frames, rest = [], []
    for i, f in enumerate(flags):
        rest.append(str(i))
        if f:
            frames.append((i, "\n".join(rest), True))
            rest = []
    if rest:
        frames.append((49, "\n".join(rest), False))
    got = stitch(df, keep=(), chunk_bits=bits, closing=True).select("line_id", "raw", "headed").collect()
    assert sorted(map(tuple, got)) == sorted(frames)


def test_large_entry_goes_on_in_parts(spark):
    rows = [("p", "p", 0, i, f"line {i:04d}", i == 3) for i in range(400)]
    schema = "source_path string, source string, block_start long, line_id long, value string, is_start boolean"
    df = spark.createDataFrame(rows, schema)
    got = stitch(df, chunk_bits=2, max_part_bytes=300).orderBy("line_id", "part").collect()
    assert "\n".join(r.raw for r in got) == "\n".join(r[4] for r in rows)
    entry = [r for r in got if r.headed]
    assert [r.part for r in entry] == list(range(len(entry))) and len(entry) > 5
    assert max(len(r.raw) for r in got) < 400


def test_block_size_does_not_matter(spark):
    folder = tempfile.mkdtemp(prefix="logweave-blocks-")
    rng = random.Random(1)
    lines = ["banner", "banner 2"]
    for i in range(600):
        lines.append(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}.000 [t] INFO a.B - entry {i} " + "x" * rng.randrange(60))
        lines += [f"  at frame {k} " + "é" * rng.randrange(40) for k in range(rng.randrange(12))]
    with open(f"{folder}/big.log", "w") as f:
        f.write("\n".join(lines) + "\n")
    fmt = Layout("%d{yyyy-MM-dd HH:mm:ss.SSS} [%t] %-5level %logger{36} - %msg%n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    results = []
    try:
        for size in (134217728, 40_000, 3_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            read = read_lines(spark, folder)
            if size == 3_000:
                assert read.select("block_start").distinct().count() > 20
            entries = parse_lines(read, fmt).orderBy("block_start", "line_id")
            results.append([(r.timestamp, r.message, r.raw) for r in entries.collect()])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 601
    assert "\n".join(r[2] for r in results[0]) == "\n".join(lines)


def test_lines_are_read_and_shuffled_once(spark):
    folder = tempfile.mkdtemp(prefix="logweave-once-")
    rows = [("p", "p", 0, i, str(i), i % 3 == 0) for i in range(100)]
    schema = "source_path string, source string, block_start long, line_id long, value string, is_start boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lines")
    df = stitch(spark.read.parquet(f"{folder}/lines"))
    assert df.count() == 34
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 3
    assert "CartesianProduct" not in final and "NestedLoop" not in final
