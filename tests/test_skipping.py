"""Search by trigram bitmaps: the same rows as a full search, and blocks left out."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.predicates import text_match
from logweave.operators import search, skipping
from logweave.session import scratch_path

WORDS = ["alpha", "Beta", "gam", "delta x", "\u00c9cole", "\U0001f600\U0001f601\U0001f602", "line\nbreak", "", "\u03a3\u0391\u03a3"]


def store(spark, rows, block_rows=50):
    entries = spark.createDataFrame(rows, "k long, message string, view string")
    path = scratch_path(spark, "searchable")
    skipping.store_searchable(entries, path, [F.col("message"), F.col("view")], ["k"], block_rows)
    return entries, path


def test_same_rows_as_a_full_search(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))), rng.choice(["one", "two", None])) for k in range(400)]
    rows += [(400, None, None), (401, "needle " * 20_000 + "Needle in hay", "one"), (402, None, "needle")]
    entries, path = store(spark, rows)
    for literal in ["needle", "NEEDLE in", "delta x alpha", "BETA", "\u00c9col", "\U0001f601\U0001f602", "e\nbr", "line\nbreak", "x", "", "absent", "\u03a3\u0391\u03a3", "two"]:
        match = text_match(literal, ["message"]) | F.coalesce(F.col("view").contains(literal), F.lit(False))
        want = sorted(r.k for r in entries.filter(match).collect())
        assert sorted(r.k for r in skipping.searchable(spark, path, literal).filter(match).collect()) == want, literal


def test_blocks_without_the_trigrams_are_not_read(spark):
    rows = [(k, f"entry {k} of " + ("a rare pearl" if k == 777 else "plain sand"), "v") for k in range(2000)]
    entries, path = store(spark, rows, block_rows=100)
    assert spark.read.parquet(f"{path}/entries").select(skipping.BLOCK).distinct().count() == 21
    assert skipping.blocks_with(spark, path, "PEARL").count() == 1
    assert skipping.blocks_with(spark, path, "absent").count() == 0
    assert skipping.blocks_with(spark, path, "pe") is None
    found = skipping.searchable(spark, path, "pearl").filter(text_match("pearl"))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.k for r in found.collect()] == [777]
    read = next(n for n in nodes(found._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet") and "search_block" in n.toString() and "message" in n.toString())
    assert read.metrics().apply("numPartitions").value() == 1
    counts = search.count_matches(skipping.searchable(spark, path, "pearl"), text_match("pearl")).collect()
    assert [(r.view, r.matches) for r in counts] == [("v", 1)]


def nodes(plan):
    """All nodes of a plan that has run, through adaptive stages."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    yield plan
    inner = [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
    children = plan.children()
    for child in [*inner, *(children.apply(i) for i in range(children.size()))]:
        yield from nodes(child)


def test_empty_table_and_taken_name(spark):
    entries, path = store(spark, [])
    assert skipping.searchable(spark, path, "needle").count() == 0
    with pytest.raises(ValueError):
        skipping.store_searchable(entries.withColumn(skipping.BLOCK, F.lit(1)), path + "x", [F.col("message")], ["k"])


def test_tasks_hold_many_small_blocks(spark, monkeypatch):
    """Blocks of a few rows are not a task each; they follow the order, hold about as many rows as asked and all rows."""
    monkeypatch.setattr(skipping, "TASK_ROWS", 500)
    _, path = store(spark, [((k * 7919) % 2000, f"entry {k}", "v") for k in range(2000)], block_rows=20)
    kept = spark.read.parquet(f"{path}/entries")
    blocks = kept.groupBy(skipping.BLOCK).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
    blocks = sorted(blocks.collect(), key=lambda b: b[skipping.BLOCK])
    assert sum(b.n for b in blocks) == 2000 and max(b.n for b in blocks) <= 20 and 100 <= len(blocks) <= 110
    assert all(a.high < b.low for a, b in zip(blocks, blocks[1:]))
    # Written by few tasks: the upper half of a block's number is its task.
    assert len({b[skipping.BLOCK] >> 32 for b in blocks}) <= 5
