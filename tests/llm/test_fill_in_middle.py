import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import fill_in_middle as module
from logweave.llm.fill_in_middle import SkipList, fill_in_middle, restored

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = [
    None, "", "a", " ", "ab", "é", "one two  three\n\nfour", "日本 語a b\t", "x" * 70_000, "1 " * 5000, "<P>", "a <M> b", "<S", "P> <",
    "end<", "word, " * 3000 + "Ünï", "a\x00b", "😀 emoji 😀😀", "<<S><P", "line\r\nline sep",
]


def plain(doc_id, text, rate=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    code = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    one, two, three = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(one), len(two), f"<S>{three}<P>{one}<M>{two}"
    return len(units), "psm", len(one), len(two), f"<P>{one}<S>{three}<M>{two}"


@pytest.mark.parametrize("scan", [1, 5, 1 << 20])
def test_every_rank_is_reached(monkeypatch, scan):
    monkeypatch.setattr(module, "SCAN_BYTES", scan)
    monkeypatch.setattr(module, "THIN_BITS", 1)
    for text in TEXTS:
        text = (text or "")[:2000]
        units, data = UNIT.findall(text), np.frombuffer(text.encode(), np.uint8)
        found = SkipList(data)
        assert (found.units, found.points) == (len(units), len(text))
        for rank in range(len(units) + 1):
            head = "".join(units[:rank])
            assert found.reach(rank) == (len(head), len(head.encode()))


def test_lanes_of_a_long_text():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("ab é,1"), 300_000))
    units, found = UNIT.findall(text), SkipList(np.frombuffer(text.encode(), np.uint8))
    assert len(found.widths) > 2 and sum(map(len, found.widths)) < len(units) / 12
    assert all(sum(w[0] for w in lane) == len(units) and sum(w[1] for w in lane) == len(text) for lane in found.widths)
    ends = np.cumsum([0, *map(len, units)])
    for rank in rng.integers(0, len(units) + 1, 300).tolist():
        assert found.reach(rank)[0] == ends[rank]


def test_forms_outputs_and_way_back(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(TEXTS * 6)] + [(None, "no id", "k", 1), (3, "again", "k", 1), (3, "again", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, FIM string, n int").repartition(3)
    made = fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "FIM", "n", "fim_"]
    got = made.withColumn("back", restored(F.col("fim_.output"), F.col("fim_.form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.fim_) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.fim_.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_empty_table(spark):
    df = spark.createDataFrame([(i, "some text here") for i in range(40)], "doc_id long, text string")
    assert {r.fim.form for r in fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r.fim.form for r in fill_in_middle(df, rate=100, spm_rate=100).collect()} == {"spm"}
    assert fill_in_middle(df.limit(0)).collect() == []
