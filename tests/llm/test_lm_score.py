import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logweave.llm import lm_score
from logweave.llm.lm_score import context_bucket, mixture_weights, pack, pack_sorted, score_texts, unpack, unpack_sorted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n", "One two THREE", "one two three four", "Ä ä a A", "the the the cat", "x" * 5000, "the cat sat\x0bon the mat"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def rows():
    rng = np.random.default_rng(4)
    texts = TEXTS + [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, n) % 50) for n in rng.integers(1, 200, 60)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, TEXTS[3]), (None, "the cat is unseen"), (7, "the dog " * 20_000)]


def plain(data):
    uni, pairs, context = Counter(), Counter(), Counter()
    for i, text in data:
        if not held(i):
            tokens = [*words(text), "</s>"]
            uni.update(tokens)
            for a, b in zip(["<s>", *tokens], tokens):
                pairs[a, b] += 1
                context[a] += 1
    return uni, pairs, context


@pytest.mark.parametrize("fan,hashes,want", [(64, 3000, 1), (4, 3000, 2), (2, 4000, 3)])
def test_counts_weights_and_scores_equal_plain_ones(spark, monkeypatch, fan, hashes, want):
    """Whatever the rounds by which chunks reach the buckets."""
    monkeypatch.setattr(lm_score, "BUCKET_HASHES", hashes)
    monkeypatch.setattr(lm_score, "FAN", fan)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
    assert lm_score.rounds(sum(len((t or "").encode()) + 8 for _, t in rows()))[0] == want
    data = rows()
    uni, pairs, context = plain(data)
    n, v = sum(uni.values()), len(uni)
    df = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, N_tokens long").repartition(3)
    got = sorted(score_texts(df).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    assert {r.train_tokens for r in got} == {n}
    samples = []
    for i, text in data:
        tokens = [*words(text), "</s>"] if not held(i) else []
        for a, b in zip(["<s>", *tokens], tokens):
            samples.append((context[a] - 1, (pairs[a, b] - 1) / max(context[a] - 1, 1) * (v + 1), (uni[b] - 1) / (n - 1) * (v + 1)))
    counts, r2, r1 = map(np.array, zip(*samples))
    weights = mixture_weights(context_bucket(counts), np.ones(len(counts)), r2, r1)
    for r, (i, text) in zip(got, sorted(data, key=lambda x: (str(x[0]), len(words(x[1])))), strict=True):
        tokens = [*words(text), "</s>"]
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known) == (i, held(i), len(tokens), sum(uni[t] > 0 for t in tokens))
        assert r.base_score == pytest.approx(sum(math.log10((uni[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
        score = 0.0
        for a, b in zip(["<s>", *tokens], tokens):
            w = weights[context_bucket(np.array([context[a]]))[0]]
            p = w[0] * pairs[a, b] / max(context[a], 1) + w[1] * uni[b] / n + w[2] / (v + 1)
            score += math.log10(p if context[a] else p / (1 - w[0]))
        # Cells a quarter of an octave wide stand between the counts and the weights.
        assert r.score == pytest.approx(score, rel=0.01)
    tested = [r for r in got if r.held_out and r.n_known > 20]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_packing():
    values = np.array([0, 1, 5, 5, 1 << 55], np.uint64)
    assert unpack(pack(values)).tolist() == unpack_sorted(pack_sorted(values)).tolist() == values.tolist()
    assert len(unpack_sorted(pack_sorted(values[:0]))) == 0


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_sent_grow_with_the_corpus():
    """Requests a chunk sends and nodes receive, at sizes from 1 GB to 1 PB: the fan and the rounds bound them."""
    for power in range(30, 51):
        n, fan = lm_score.rounds(1 << power)
        buckets = (1 << power) / 7.8 / lm_score.BUCKET_HASHES
        assert fan <= lm_score.FAN and fan**n >= 0.99 * buckets
        assert n <= 1 + math.log(max(buckets, 1)) / math.log(lm_score.FAN)
        # The last round takes one row of each group of the round before.
        assert (1 << power) / lm_score.CHUNK_BYTES / fan ** (n - 1) <= 4 * lm_score.FAN
