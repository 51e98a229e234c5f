"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy on a bounded sample."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import crc_remainder
from logweave.llm.words import Rolling, distinct_words, slices, text_bytes

# Bounds of the training sample: documents per label, chosen by a hash of the id.
SAMPLE = {1: 1200, 0: 3000}
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIM = 4
PASSES = 12
BATCH = 128
# Averages over whole texts are small numbers; the softmax sees them times this.
GAIN = 50.0
# A toxic text that is missed costs so much more than a clean one that is accused.
MISSED = 1.5
# Blank words added to each average, so that one odd word does not decide over a short text.
PAD = 10
# Squared gradient a subword starts with: those seen a few times only move little.
CALM = 3e-6
SLICE = 1 << 19

_ROLL = Rolling(seed=11)


def _subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words in a row, and how many each word has. A word's bytes end in a blank, which
    marks its end; a subword is a run of 3 to 5 bytes, the blank before the word standing for its start, or the whole word."""
    n = len(bounds) - 1
    # A blank before the first word, so that every word has one before and one after it.
    data = np.concatenate([[np.uint8(32)], data])
    begin, end = bounds[:-1], bounds[1:] + 1
    starts, stops, owners = [begin], [end], [np.arange(n)]
    size = end - begin
    for gram in GRAMS:
        count = np.maximum(size - gram + 1, 0)
        owner = np.repeat(np.arange(n), count)
        first = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        starts.append(first)
        stops.append(first + gram)
        owners.append(owner)
    start, stop, owner = map(np.concatenate, (starts, stops, owners))
    bucket = (_ROLL.runs(_ROLL.values[data], start, stop) & np.uint64(BUCKETS - 1)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=n)


def _text_words(token: np.ndarray, first: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, word) pairs: a word that a text repeats counts once."""
    pairs = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * kinds + token)
    return pairs // kinds, pairs % kinds


@dataclass
class Model:
    """Toxicity of a text is sigmoid(gain * mean + bias), the mean being over its distinct words and ``PAD`` blank ones, a word's
    value the mean over its subwords of embedding times softmax weights, kept as one number per subword."""

    weight: np.ndarray
    bias: float

    def word_values(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        bucket, count = _subwords(data, bounds)
        return np.add.reduceat(self.weight[bucket], np.cumsum(count) - count) / count

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores between 0 and 1; a text without words has the score of the bias alone."""
        data, offsets = text_bytes(column)
        value = np.zeros(len(column))
        for i, j in slices(offsets, SLICE):
            words, bounds, token, first = distinct_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(token):
                text, word = _text_words(token, first, len(bounds) - 1)
                total = np.bincount(text, self.word_values(words, bounds)[word], j - i)
                value[i:j] = total / (np.bincount(text, minlength=j - i) + PAD)
        return 1 / (1 + np.exp(-np.clip(GAIN * value + self.bias, -30, 30)))


def bag(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Subword buckets of each text and their shares in the text's average."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, SLICE):
        words, bounds, token, first = distinct_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        bucket, count = _subwords(words, bounds) if len(token) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        begin = np.cumsum(count) - count
        for k in range(j - i):
            word = np.unique(token[first[k] : first[k + 1]])
            n = count[word]
            at = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            share = np.repeat(1 / np.maximum(n, 1), n) / (len(word) + PAD)
            kinds, which = np.unique(bucket[at], return_inverse=True)
            yield kinds, np.bincount(which, share, len(kinds))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Model:
    """Fit embeddings (bucket x dim) and softmax weights (dim x 2) together by Adagrad.

    With texts of one label only, that label is the answer for all; without any, all are clean.
    """
    labels = np.asarray(labels, np.int64)
    if not len(bags) or len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), 4.0 if only else -4.0)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.001, (BUCKETS, DIM))
    soft = np.zeros((DIM, 2))
    soft[:, 1] = rng.normal(0, 0.5, DIM)
    soft[:, 0] = -soft[:, 1]
    bias = np.zeros(2)
    order = rng.permutation(len(bags))
    steps = [order[low : low + BATCH] for low in range(0, len(order), BATCH)]
    seen_embed, seen_soft, seen_bias = np.full(BUCKETS, CALM), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    for turn in range(PASSES):
        rate = 0.5 * (1 - turn / PASSES)
        for s in rng.permutation(len(steps)):
            # Put together anew in each pass: kept for all steps, this would be another copy of the sample.
            pick = steps[s]
            row = np.repeat(np.arange(len(pick)), [len(bags[k][0]) for k in pick])
            kinds = np.concatenate([bags[k][0] for k in pick])
            share = np.concatenate([bags[k][1] for k in pick])
            mean = np.stack([np.bincount(row, share * embed[kinds, d], len(pick)) for d in range(DIM)], 1)
            logit = GAIN * mean @ soft + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= np.where(labels[pick] == 1, MISSED, 1.0)[:, None] / len(pick)
            d_soft, d_bias, d_mean = GAIN * mean.T @ p, p.sum(0), GAIN * p @ soft.T
            d_embed = np.stack([np.bincount(kinds, share * d_mean[row, d], BUCKETS) for d in range(DIM)], 1)
            seen_embed += (d_embed**2).mean(1)
            embed -= rate * d_embed / np.sqrt(seen_embed[:, None])
            seen_soft += d_soft**2
            soft -= 0.2 * rate * d_soft / np.sqrt(seen_soft)
            seen_bias += d_bias**2
            bias -= 0.2 * rate * d_bias / np.sqrt(seen_bias)
    return Model(embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model:
    """Train on labelled documents outside the held-out fold (``crc_remainder`` 0).

    The sample is bounded by ``SAMPLE`` documents per label, chosen by a hash of the id over all labels, so the task that trains
    gets a bounded number of subword bags whatever the corpus. Null labels and texts without a word are no examples.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL")
    known = known.filter(F.col("label").isin(0, 1) & (crc_remainder("id", folds) != 0))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in SAMPLE.items()]
    chosen = chosen[0].unionByName(chosen[1])
    # At most the sample's bound of rows is broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.slice(low, 64)
                bags = list(bag(part["text"]))
                columns = [
                    part["id"].cast(pa.string()),
                    part["label"],
                    pa.array([k.astype("<i4").tobytes() for k, _ in bags], pa.binary()),
                    pa.array([s.astype("<f4").tobytes() for _, s in bags], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "kinds", "shares"])

    got = rows.mapInArrow(run, "id string, label int, kinds binary, shares binary")
    # Ids may repeat in the documents; the bound holds for rows too.
    sample = got.orderBy("id", F.xxhash64("kinds")).limit(sum(SAMPLE.values()))
    # One task trains on the bounded sample, so that the driver only gets the model. A lost executor repeats the task.
    learned = sample.select("label", "kinds", "shares").mapInArrow(_train_task, "weight binary, bias double").first()
    return Model(np.frombuffer(learned.weight, "<f8"), learned.bias) if learned else train([], [])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (weight, bias): the model of all rows (label, kinds, shares) that have a subword; none without a row."""
    batches = list(batches)
    # Views into the batches, no copies.
    rows = [
        (label, np.frombuffer(k.as_buffer(), "<i4"), np.frombuffer(s.as_buffer(), "<f4"))
        for batch in batches
        for label, k, s in zip(batch["label"].to_pylist(), batch["kinds"], batch["shares"], strict=True)
        if len(k.as_buffer())
    ]
    if any(len(batch) for batch in batches):
        model = train([(k, s) for _, k, s in rows], [label for label, _, _ in rows])
        columns = [pa.array([model.weight.astype("<f8").tobytes()], pa.binary()), pa.array([model.bias], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["weight", "bias"])


def with_score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the toxicity score of the whole text, 0 to 1, in a new column. Null texts are empty texts."""
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {score_col} already")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(sent.value.score(column), pa.float64())

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) for every row of ``docs`` (doc_id, text).

    Empty and null texts get a score too, that of no evidence. Repeated rows are scored alike; an empty table gives no rows.
    """
    model = fit(docs, labels, folds=folds)
    rows = docs.select("doc_id", "text", (crc_remainder("doc_id", folds) == 0).alias("held_out"))
    scored = with_score(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that are not predicted toxic, columns unchanged."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    clean = with_score(packed, fit(docs, labels)).filter("score < 0.5")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in names])
