import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm.common import stored
from logweave.llm.exact_dedup import digest_rows, exact_groups, merge_runs
from logweave.llm.mixing import mix_sources, repeat_documents

# Copies, an empty and a null text, a repeated row, null ids and a very long text.
ROWS = [(1, "a b"), (2, "a b"), (3, "a  b"), (4, ""), (5, None), (6, "x"), (6, "x"), (None, "x"), (7, "w " * 100_000)]
ROWS += [(100 + k, "copy") for k in range(300)]


@pytest.mark.parametrize("keep,fan_in", [("largest", 2), ("smallest", 2), ("largest", 16)])
def test_groups_equal_brute_force(spark, keep, fan_in):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(9)
    docs = docs.withColumns({"digest": F.lit(0), "first": F.lit("clash"), "n": F.lit(None).cast("int")})
    groups = defaultdict(list)
    for i, text in ROWS:
        groups[text or ""].append(i)
    low = -1
    best = {t: sorted(ids, key=lambda i: low if i is None else i)[-1 if keep == "largest" else 0] for t, ids in groups.items()}
    want = [
        (i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS
    ]
    got = exact_groups(docs, keep=keep, fan_in=fan_in).collect()
    plain = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    assert sorted(plain, key=str) == sorted(want, key=str)
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted([(hashlib.sha256(t.encode()).hexdigest(), i) for t, i in best.items()], key=str)


@pytest.mark.parametrize("fan_in,lane_rows,rounds", [(2, 50, 4), (4, 1 << 20, 2), (16, 7, 1)])
def test_runs_stay_sorted_and_meet_in_rounds(spark, fan_in, lane_rows, rounds):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(9)
    rows = stored(digest_rows(docs), "digests")
    root = merge_runs(rows, "smallest", fan_in, lane_rows)
    plan = root._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan and plan.count("SortAggregate") == 2 * (rounds + 1)
    assert root._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == rounds + 1
    got = {bytes(r.digest): (r["first"].id, r.n) for r in root.collect()}
    want = defaultdict(list)
    for i, text in ROWS:
        want[hashlib.sha256((text or "").encode()).digest()].append(i)
    assert got == {d: (None if None in ids else min(ids), len(ids)) for d, ids in want.items()}


def test_equal_digests_of_unequal_texts_stay_apart(spark):
    """Rows made to share a digest: the second hash and the length tell them apart."""
    rows = [(1, 5, 3, 0), (2, 5, 3, 1), (3, 6, 3, 1), (4, 5, 4, 2), (5, 6, 3, 0)]
    made = spark.createDataFrame([(i, b"d" * 32, c, n, leaf, i) for i, c, n, leaf in rows], "id long, digest binary, check long, n_bytes long, leaf int, tag long")
    got = {(r["first"].id, r.n) for r in merge_runs(made, fan_in=2).collect()}
    assert got == {(1, 2), (3, 2), (4, 1)}


def test_exact_groups_of_no_rows(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mix_meets_targets_and_repeats(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 23)), "abc"[min(k % 6, 2)]) for k in range(900)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "one two", None), (1003, "long " * 40, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    first = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str) and len(first) == len(rows)
    source = {i: s for i, _, s in rows}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in first:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and 0 <= r.copies <= 2
        total[s] += r.size
        taken[s] += r.size * r.copies
        target[s] = r.target
    # Weights 5, 2, 1 and 5 again for null; sources that would pass twice their size stop there.
    left, open_, weight = 1.5 * sum(total.values()), set(total), {"a": 5, "b": 2, "c": 1, None: 5}
    want = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in full or open_:
            want[s] = 2.0 * total[s] if full else level * weight[s]
        left -= sum(want[s] for s in full)
        open_ -= full or open_
    for s in total:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(words.values())


def test_mix_of_no_rows(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_repeated_documents_are_the_mix(spark):
    """Nulls, an empty and a very long text, repeated rows and columns named like those used inside."""
    rows = [(k % 60, " ".join(["w"] * (1 + k % 5)), "ab"[k % 2], k) for k in range(80)]
    rows += [(7, "w w w", "b", 7), (90, None, "a", 1), (91, "", None, 2), (92, "x y", None, 3), (None, "n " * 9, "a", 4), (93, "long " * 20_000, "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    docs = docs.withColumns({"size": F.lit("s"), "row": F.lit(1), "u": F.lit(None).cast("int")})
    mix = repeat_documents(docs)
    assert mix.columns == docs.columns
    taken, words, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mix.collect():
        assert (r.size, r.row, r.u) == ("s", 1, None) and (r.doc_id, r.text, r.source, r.copies) in rows and r.text
        taken[r.source] += len(r.text.split())
        n[(r.doc_id, r.text, r.source, r.copies)] += 1
    for i, text, source, _ in rows:
        words[source] += len((text or "").split())
    assert all(k <= 2 * rows.count(row) for row, k in n.items())
    assert sum(taken.values()) == sum(r.size * r.copies for r in mix_sources(docs).collect())
    assert all(taken[s] <= 2 * words[s] for s in taken)
    assert repeat_documents(docs.limit(0)).count() == 0
