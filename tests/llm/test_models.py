import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import language_id, toxicity
from logweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_kneser_ney_sums_to_one_and_equals_the_plain_formula():
    counts = {"a": {"   x": 3, "  xy": 2, " xy ": 2, "  x ": 1}, "b": {"   z": 1, "  z ": 1}}
    model = language_id.build(counts)
    symbols = sorted({c for g in [*counts["a"], *counts["b"]] for c in g})
    for k in range(2):
        for context in ("   ", "  x", " xy", "qqq"):
            total = 0.0
            for c in [*symbols, None]:
                text = context + (c or "\U0010ffff")
                points = np.array([ord(x) for x in text], np.uint32)
                words = language_id.LetterWords(points, np.array([0, 4]), np.zeros(1, int), np.array([0, 1]))
                total += math.exp(model.word_logs(words)[0, k])
            assert total == pytest.approx(1.0)
    # p(y | "  x") in a: 2 of 3, of counts 3, 2, 2, 1 with the discount 1 / (1 + 2 * 2), plus what shorter grams add.
    discount = 1 / 5
    points = np.array([ord(x) for x in "  xy"], np.uint32)
    words = language_id.LetterWords(points, np.array([0, 4]), np.zeros(1, int), np.array([0, 1]))
    assert math.exp(model.word_logs(words)[0, 0]) > (2 - discount) / 3


def rows(spark, sf_dir, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = rows(spark, SF, "op2_language_id")
    assert got.keys() == lang.keys() and all(r.held_out == held(i) for i, r in got.items())
    tested = [i for i in lang if held(i)]
    assert sum(got[i].lang_pred == lang[i] for i in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_an_id_counts_once_in_training(spark):
    docs = [(1, "same text", "en"), *[(2, f"text {'abc'[k % 3]}", "de") for k in range(30)], (3, None, "en")]
    df = spark.createDataFrame([d for d in docs if not held(d[0])], "doc_id long, text string, lang string")
    chosen = language_id.sample(df, 5).collect()
    assert sorted(r.id for r in chosen) == sorted({d[0] for d in docs if not held(d[0])})
    once = df.groupBy("doc_id", "lang").agg({"text": "min"}).toDF("doc_id", "lang", "text")
    one, two = language_id.fit(df, 5), language_id.fit(once, 5)
    assert one.languages == two.languages
    texts = pa.array(["text a", "some text", "zzz"])
    assert np.array_equal(one.entropies(texts)[0], two.entropies(texts)[0])


def test_language_column_of_the_input_stays(spark):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet").limit(50), 5)
    df = spark.createDataFrame([("some words", "kept")], "text string, Language string")
    row = language_id.with_language(df, model).first()
    assert row.Language == "kept" and row.language_.lang in model.languages


def test_toxicity_of_held_out_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows(spark, SF, "op1_toxicity")
    assert len(got) == 1000 and all(r.held_out == held(i) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    tested = [i for i in toxic if held(i)]
    assert sum(got[i].predicted == toxic[i] for i in tested) >= 0.9 * len(tested)


def test_misspellings_share_subwords():
    clean = [f"plain words number {k} and nothing else here" for k in range(60)]
    bad = [f"you horrible scoundrel number {k} go away" for k in range(60)]
    bags = list(toxicity.bag(pa.array(clean + bad)))
    model = toxicity.train(bags, np.array([0] * 60 + [1] * 60))
    scores = model.score(pa.array(["the scoundrell again", "the scounndrel again", "some plain words", "", None]))
    assert scores[0] > scores[2] and scores[1] > scores[2] and scores[3] == scores[4]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = [(1, None, "en", "s", 0), (None, "no id", "en", "s", 5), (2, "", None, None, 0), (3, "12 %", "en", "s", 4)]
    docs += [(4, "wort " * 50_000, "de", "s", 1), (4, "wort " * 50_000, "de", "s", 1), (6, "a word", "en", "s", 1)]
    for kind, data in (("some", docs), ("none", [])):
        folder = str(tmp_path / kind)
        spark.createDataFrame(data, SHAPE).write.parquet(f"{folder}/documents.parquet")
        labels = [(6, 1, 0), (4, 1, None)] if data else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        for name in ("op1_toxicity", "op2_language_id"):
            got = QUERIES[name](spark, folder).collect()
            assert len(got) == len(data) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
            if name == "op2_language_id":
                assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) for r in got if r.doc_id is not None)
