"""Ordering, synchronisation, merging, lookup and search against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.predicates import text_match
from logweave.operators import search, timeline
from logweave.operators.ordered import carry_forward
from logweave.session import attach, small_side

T0 = dt.datetime(2024, 1, 1)


def entries_of(spark, rng, n=120, views="abc", nulls=0.1):
    rows = []
    for i in range(n):
        ts = None if rng.random() < nulls else T0 + dt.timedelta(seconds=rng.choice([rng.randrange(0, 500), 77, 78]))
        rows.append((rng.choice(views), ts, i))
    return rows, spark.createDataFrame(rows, "view string, timestamp timestamp_ntz, entry_key long").repartition(4)


@pytest.mark.parametrize("bucket_seconds,as_table", [(1, False), (60, True), (100_000, False)])
def test_sync_views(spark, bucket_seconds, as_table):
    rng = random.Random(bucket_seconds)
    rows, entries = entries_of(spark, rng)
    rows = [r for r in rows if r[0] != "z"]
    anchors = [(i, rng.choice("abz"), T0 + dt.timedelta(seconds=rng.randrange(-50, 600))) for i in range(60)]
    anchors += [(100, "a", None), (101, "b", T0 + dt.timedelta(seconds=77)), (102, "c", T0 + dt.timedelta(seconds=77))]
    df = spark.createDataFrame(anchors, "anchor_id long, view string, timestamp timestamp_ntz")
    views = ["a", "b", "c", "z"]
    if as_table:
        views = spark.createDataFrame([(v,) for v in [*views, None, "a"]], "view string")
    got = timeline.sync_views(entries, df, views, bucket_seconds=bucket_seconds, visible=F.col("entry_key") % 2 == 0)
    got = {(r.anchor_id, r.view): (r.timestamp, r.entry_key, r.clamped, r.visible) for r in got.collect()}
    want = {}
    for anchor, view, at in anchors:
        for v in "abcz":
            if v == view:
                continue
            timed = sorted((ts, k) for w, ts, k in rows if w == v and ts is not None)
            after = [x for x in timed if at is not None and x[0] >= at]
            hit = None if at is None or not timed else (after[0] if after else timed[-1])
            want[anchor, v] = (None, None) if hit is None else (hit[0], hit[1])
            if hit is not None:
                assert got[anchor, v][2:] == (not after, hit[1] % 2 == 0)
    assert {k: v[:2] for k, v in got.items()} == want


def test_sync_many_views_of_a_table(spark):
    """100 000 views: neither the driver nor the plan holds their names."""
    n = 100_000
    entries = spark.range(n).select(
        F.concat(F.lit("v"), "id").alias("view"), F.lit(T0).cast("timestamp_ntz").alias("timestamp"), F.col("id").alias("entry_key")
    )
    anchors = spark.createDataFrame([(1, "v5", T0), (2, "none", T0 + dt.timedelta(seconds=1))], "anchor_id long, view string, timestamp timestamp_ntz")
    found = timeline.sync_views(entries, anchors)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    got = {(r.anchor_id, r.clamped): r.n for r in found.groupBy("anchor_id", "clamped").agg(F.count("entry_key").alias("n")).collect()}
    assert got == {(1, False): n - 1, (2, True): n}


def test_sync_linked_views(spark):
    rng = random.Random(11)
    rows, entries = entries_of(spark, rng)
    links = [("a", "b"), ("a", "z"), ("b", "b"), ("c", "a"), ("a", "b")]
    anchors = [(i, rng.choice("abcq"), T0 + dt.timedelta(seconds=rng.randrange(-50, 600))) for i in range(40)]
    df = spark.createDataFrame(anchors, "anchor_id long, view string, timestamp timestamp_ntz")
    table = spark.createDataFrame(links, "anchor_view string, view string")
    got = sorted((r.anchor_id, r.view, r.entry_key or -1) for r in timeline.sync_views(entries, df, table).collect())
    want = []
    for anchor, own, at in anchors:
        for view in sorted({v for a, v in links if a == own and v != own}):
            timed = sorted((ts, k) for w, ts, k in rows if w == view and ts is not None)
            after = [k for ts, k in timed if ts >= at]
            want.append((anchor, view, (after[0] if after else timed[-1][1]) or -1 if timed else -1))
    assert got == sorted(want)


def test_sync_to_one_time(spark):
    rng = random.Random(3)
    rows, entries = entries_of(spark, rng)
    at = T0 + dt.timedelta(seconds=77)
    got = {r.view: (r.timestamp, r.entry_key) for r in timeline.sync_to(entries, at, source_view="a").collect()}
    want = {v: min((ts, k) for w, ts, k in rows if w == v and ts is not None and ts >= at) for v in "bc"}
    assert got == want


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_sort_time(spark, bits):
    rng = random.Random(bits)
    rows = []
    for source in ("a", "b", "c"):
        for i in range(60):
            ts = None if rng.random() < {"a": 0.5, "b": 0.05, "c": 1.0}[source] else T0 + dt.timedelta(seconds=rng.randrange(900))
            rows.append((source, i // 20, i, ts))
    df = spark.createDataFrame(rows, "source_path string, block_start long, line_id long, timestamp timestamp_ntz")
    got = {(r.source_path, r.line_id): r.sort_ts for r in timeline.with_sort_time(df, chunk_bits=bits).collect()}
    for source, _, i, ts in rows:
        same = [(r[2], r[3]) for r in rows if r[0] == source and r[3] is not None]
        later = [t for k, t in same if k >= i]
        want = later[0] if later else (same[-1][1] if same else None)
        assert got[source, i] == want


def test_carry_forward(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, None, None, i])) for g in "xy" for i in range(70)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(3)
    got = carry_forward(df, ["g"], F.shiftright("i", 2), ["i"], F.col("v"), "last")
    state, want = {}, {}
    for g, i, v in rows:
        state[g] = v if v is not None else state.get(g)
        want[g, i] = state[g]
    assert {(r.g, r.i): r.last for r in got.collect()} == want


def merged_rows(spark):
    rows = [
        ("a", T0, "p", 0, 0, "one"), ("a", None, "p", 0, 1, "two"), ("b", T0, "q", 0, 0, "three"), ("c", None, "r", 0, 0, "four"),
    ]
    return spark.createDataFrame(
        rows, "view string, timestamp timestamp_ntz, source_path string, block_start long, line_id long, message string"
    )


def test_merge_and_unmerge(spark):
    df = merged_rows(spark)
    merged = timeline.merge_views(df, ["a", "b"])
    got = [(r.origin_view, r.message) for r in timeline.chronological(timeline.with_sort_time(merged)).collect()]
    assert got == [("a", "one"), ("a", "two"), ("b", "three")]
    assert {r.message for r in timeline.unmerge(merged, "a").collect()} == {"one", "two"}
    with pytest.raises(ValueError, match="'c'"):
        timeline.merge_views(df, ["a", "c"])
    with pytest.raises(ValueError):
        timeline.merge_views(df, [])


def test_find_views(spark):
    views = spark.createDataFrame(
        [("v1", 1, "app", "h", 1), ("v2", 2, "app", "h", 2), ("v3", 3, "RemoteApp", "h", 5), ("v4", 4, "RemoteApp", "h", 6)],
        "view string, position long, app string, ip string, port int",
    )
    events = spark.createDataFrame(
        [(1, "app", "h", 9), (2, "RemoteApp", "h", 6), (3, "RemoteApp", "h", 7), (4, None, "h", 1), (5, "app", None, 1)],
        "id long, app string, ip string, port int",
    )
    got = {r.id: r.view for r in timeline.find_views(events, views).collect()}
    assert got == {1: "v1", 2: "v4", 3: None, 4: None, 5: None}


def test_search_steps(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), i, rng.choice(["Error x", "fine", "errors"])) for i in range(60)]
    df = spark.createDataFrame(rows, "view string, k long, message string").repartition(4)
    match = text_match("error", whole_word=True)
    hits = {v: [k for w, k, m in rows if w == v and m == "Error x"] for v in "abc"}

    def one(found):
        got = found.collect()
        return (got[0].view, got[0].k) if got else None

    views = ["b", "c", "a"]
    for view in "abc":
        only = df.filter(F.col("view") == view)
        for cursor in (0, 17, 30, 59):
            later, earlier = [k for k in hits[view] if k > cursor], [k for k in hits[view] if k < cursor]
            assert one(search.find_next(only, match, ["k"], [cursor])) == ((view, later[0]) if later else None)
            assert one(search.find_next(only, match, ["k"], [cursor], backward=True)) == ((view, earlier[-1]) if earlier else None)
        turn = views[views.index(view) :] + views[: views.index(view)]
        for cursor, backward in ((59, False), (0, True), (30, False)):
            order = [turn[0], *reversed(turn[1:])] if backward else turn
            want = None
            for v in order:
                ks = [k for k in hits[v] if v != view or (k < cursor if backward else k > cursor)]
                if ks:
                    want = (v, ks[-1] if backward else ks[0])
                    break
            got = one(search.find_next_in_views(df, match, views, ["k"], view, [cursor], backward))
            assert got == want
    assert one(search.find_next(df, text_match("absent"), ["k"])) is None


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_is_the_same_with_and_without_broadcast(spark, how):
    big = spark.createDataFrame([("hot" if i % 3 else str(i % 7), i) for i in range(300)], "k string, i long")
    small = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3), ("unused", 4)], "k string, v int")
    broadcast = attach(big, small, ["k"], how)
    salted = attach(big, small, ["k"], how, salts=8, max_rows=1)
    assert small_side(small, 3) is None
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    rows = lambda df: sorted((r.k, r.i, r.v or 0) for r in df.collect())
    known = {"hot": 1, "0": 2, "3": 3}
    keys = [("hot" if i % 3 else str(i % 7), i) for i in range(300)]
    want = sorted((k, i, known.get(k, 0)) for k, i in keys if how == "left" or k in known)
    assert rows(broadcast) == rows(salted) == want


def test_positions_equal_row_numbers(spark):
    """Over all rows and per group, with one group that holds most rows, over many ranges."""
    from logweave.operators.ordered import with_positions

    rows = [("hot" if k % 5 else f"g{k % 3}", (k * 7919) % 1009, k) for k in range(1009)]
    df = spark.createDataFrame(rows, "g string, at int, id int").repartition(5)
    got = with_positions(with_positions(df, ["at", "id"]), ["at", "id"], by=["g"], out="own").collect()
    everything = {k: n for n, (_, _, k) in enumerate(sorted(rows, key=lambda r: r[1:]), 1)}
    own = {}
    for g in {r[0] for r in rows}:
        own |= {k: n for n, (_, _, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1)}
    assert len(got) == len(rows) and all((r.position, r.own) == (everything[r.id], own[r.id]) for r in got)
    assert with_positions(df.limit(0), ["at"]).count() == 0
    down = with_positions(df, [F.col("at").desc(), "id"]).filter("position = 1").first()
    assert down.at == max(r[1] for r in rows)
