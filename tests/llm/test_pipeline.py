import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from logweave.llm.queries import QUERIES, byte_bpe_50k
from logweave.llm.simhash import fingerprint_texts

SF = "/root/testdata/sf0.001"


def test_stages_in_order_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "token_output":
            assert docs.columns == before.columns
            kept[name] = [r.doc_id for r in docs.collect()]
    toxic = {r.doc_id for r in QUERIES["op1_toxicity"](spark, SF).collect() if r.predicted}
    assert toxic and sorted(kept["toxicity"]) == sorted(set(rows) - toxic)

    ids = sorted(kept["toxicity"])
    prints = fingerprint_texts(pa.array([rows[i].text for i in ids]))
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1)):
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    assert sorted(kept["near_dedup"]) == sorted({ids[find(k)] for k in range(len(ids))})

    leaked = {i for i in kept["near_dedup"] if any(b in rows[i].text for b in benchmark)}
    assert leaked and sorted(kept["decontamination"]) == sorted(set(kept["near_dedup"]) - leaked)

    copies = Counter(kept["mixing"])
    assert set(copies) <= set(kept["decontamination"]) and max(copies.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in kept["decontamination"]}
    assert abs(sum(size[i] * n for i, n in copies.items()) / (1.5 * sum(size.values())) - 1) < 0.1

    tokenizer = Tokenizer.from_file(byte_bpe_50k())
    out = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(kept["mixing"])
    for r in out:
        assert r.n_tokens == len(tokenizer.encode(rows[r.doc_id].text, add_special_tokens=False).ids) + 1


def test_empty_table(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
