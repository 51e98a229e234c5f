import re

import duckdb
import numpy as np
import pytest

from logweave.llm import substring
from logweave.llm.substring import deep_nodes, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def plain(rows):
    """(doc_id, n_words, n_removed, kept) by a dictionary of all windows in corpus order."""
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = True
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((str(rows[k][0]), len(words), int(gone.sum()), kept))
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, Start long").repartition(3)
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in remove_repeats(df).collect())


def test_nodes_at_depth_are_equal_runs():
    word = np.array([1, 2, 1, 2, 1, 2, 1, 3])
    node = deep_nodes(word, np.array([0, 2, 4, 1]), depth=4)
    assert node[0] == node[1] and len(set(node.tolist())) == 3


@pytest.mark.parametrize("group,held", [(50_000, 100_000), (2, 5)])
def test_repeats_equal_brute_force(spark, monkeypatch, group, held):
    monkeypatch.setattr(substring, "GROUP_SUFFIXES", group)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 3000, 400)]
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(k, " ".join(base[a : a + 90])) for k, a in enumerate(rng.integers(0, 300, 12))]
    rows += [(100 + k, f"start {k} {passage}\n end {k} " + " ".join(base[k : k + 19])) for k in range(30)]
    rows += [(40, passage), (41, None), (42, ""), (43, "few words only"), (44, "x " * 300), (45, "a b " * 3000 + passage)]
    rows += [(46, " ".join(base[:20])), (47, "  ".join(base[:21])), (None, passage + " tail"), (2, None)]
    assert got(spark, rows) == plain(rows)


def test_whole_table_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got(spark, rows) == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"q{k}" for k in range(40))
    assert [r[2] for r in got(spark, [(1, text), (1, text), (2, text)])] == [0, 0, 40]
    assert got(spark, []) == []
