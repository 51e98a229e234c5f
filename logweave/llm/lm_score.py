"""Language-model scores: word unigrams and bigrams by deleted interpolation, counted over the whole corpus.

Texts are packed into chunks, one row each, of word numbers and the chunk's distinct word hashes. A chunk asks for the corpus
counts of its distinct words and bigrams: the sorted hashes are cut by hash range into buckets, each bucket adds up what
all chunks have, and sends the totals back in the order asked. So a frequent word or bigram is one entry per
chunk, not one per occurrence, and no table of counts is ever on the driver or broadcast.

Chunks reach the buckets in rounds of at most ``FAN`` ranges: in each round but the last, about as many chunks as there are ranges meet, are
merged and cut into finer ranges, and the totals come back the same way. So a chunk sends at most ``FAN`` rows a round, the rounds are
the logarithm of the number of buckets, and rows grow with the corpus and that logarithm, not with its square.
"""

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import crc_remainder, stored, whole_text
from logweave.llm.words import Rolling, mix64, text_slices

CHUNK_BYTES = 5 << 20
# Hashes that one bucket gathers, about.
BUCKET_HASHES = 2_000_000
# Ranges that hashes are cut into in one round.
FAN = 64
HASH_BITS = 56
# Context frequencies 0, 1, 2-3, 4-7, ... and steps per octave of the cells in which EM sees the counts.
CONTEXTS = 32
STEPS = 4
ROUNDS = 60
ADD = 0.1

_ROLL = Rolling(seed=31)
_MASK = np.uint64((1 << HASH_BITS) - 1)
# The hashes of the end token and of the start context, which no word has but by a chance of 2**-56.
END, START = np.uint64(1), np.uint64(2)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed byte planes of their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def bigram_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of word hashes; the order matters."""
    with np.errstate(over="ignore"):
        return mix64(first * np.uint64(0xD6E8FEB86659FD93) + mix64(second)) & _MASK


def _chunk(parts: list[tuple[np.ndarray, np.ndarray]], ids: list, held: list[bool]) -> dict:
    """A chunk row from the word hashes and word counts of its texts."""
    hashes = np.concatenate([h for h, _ in parts])
    sizes = np.concatenate([n for _, n in parts])
    kinds, place = np.unique(hashes, return_inverse=True)
    return {
        "chunk": uuid.uuid4().hex,
        "ids": ids,
        "held": held,
        "words": pack_sorted(kinds),
        "sequence": pack(place),
        "sizes": pack(sizes),
    }


def chunks(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    """One row per chunk of whole texts: chunk, ids, held, words, sequence, sizes. Written once, so its key is stable."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        (crc_remainder(id_col, folds) == 0).alias("held"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = pa.list_(pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, held, size = [], [], [], 0

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            row = _chunk(parts, [], held)
            columns = [
                pa.array([row["chunk"]]),
                pa.array([ids], pa.list_(id_type)),
                pa.array([held], kind),
                *[pa.array([row[c]], pa.binary()) for c in ("words", "sequence", "sizes")],
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "held", "words", "sequence", "sizes"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, j, words in text_slices(batch["text"], lower=True):
                parts.append((_ROLL.words(words) & _MASK | np.uint64(4), np.diff(words.first)))
                ids += batch["id"].slice(i, j - i).to_pylist()
                held += batch["held"].slice(i, j - i).to_pylist()
                size += len(words.data) + 64 * (j - i)
                if size >= CHUNK_BYTES:
                    yield out(id_type)
                    parts, ids, held, size = [], [], [], 0
        if ids:
            yield out(id_type)

    id_kind = rows.schema["id"].dataType.simpleString()
    shape = f"chunk string, ids array<{id_kind}>, held array<boolean>, words binary, sequence binary, sizes binary"
    return stored(rows.mapInArrow(run, shape), "lm-chunks")


class Chunk:
    """A chunk's tokens: hashes of each token and of the context before it, the text and the training mark of each."""

    def __init__(self, row: dict):
        words, sizes = unpack_sorted(row["words"]), unpack(row["sizes"]).astype(np.int64)
        self.ids, held = row["ids"], np.array(row["held"], bool)
        sequence = words[unpack(row["sequence"]).astype(np.int64)] if len(words) else np.zeros(0, np.uint64)
        stop = np.cumsum(sizes + 1)
        self.n_tokens = sizes + 1
        self.token = np.full(int(stop[-1]), END, np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[stop - 1] = False
        self.token[inner] = sequence
        self.context = np.concatenate([[START], self.token[:-1]])
        self.context[stop[:-1]] = START
        self.text = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.learn = ~held[self.text]
        self.held = held

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct unigrams and bigrams and their numbers in the training texts. Each text has one start."""
        n_learn = int((~self.held).sum())
        words, place = np.unique(self.token, return_inverse=True)
        uni = np.bincount(place, self.learn, len(words)).astype(np.uint64)
        words = np.insert(words, 1, START)  # after END, the least hash
        uni = np.insert(uni, 1, n_learn)
        pairs, place = np.unique(bigram_hashes(self.context, self.token), return_inverse=True)
        return words, uni, pairs, np.bincount(place, self.learn, len(pairs)).astype(np.uint64)


REQUEST = "bucket long, grp long, sender string, words binary, uni binary, pairs binary, bi binary"
REPLY = "bucket long, sender string, uni binary, bi binary"


def rounds(size: int) -> tuple[int, int]:
    """(rounds, ranges a round) by which texts of ``size`` bytes reach buckets of about ``BUCKET_HASHES`` hashes."""
    # A word takes six bytes or so, and about one token in 1.3 is another bigram of its chunk.
    buckets = max(1, round(size / 6 / 1.3 / BUCKET_HASHES))
    n = 1
    while FAN**n < buckets:
        n += 1
    fan = max(1, math.ceil(buckets ** (1 / n) - 1e-9))
    return n, fan


def _cut(run: tuple, sender: str, group: int, low: int, fan: int, total: int) -> pa.RecordBatch:
    """Requests of a sorted run (words, their counts, pairs, their counts) to the ``fan`` buckets from ``low`` of ``total``."""
    words, uni, pairs, bi = run
    edges = np.array([(k << HASH_BITS) // total for k in range(low + 1, low + fan)], np.uint64)
    cut_w = [0, *np.searchsorted(words, edges).tolist(), len(words)]
    cut_p = [0, *np.searchsorted(pairs, edges).tolist(), len(pairs)]
    blobs = [[], [], [], []]
    for k in range(fan):
        w, p = slice(cut_w[k], cut_w[k + 1]), slice(cut_p[k], cut_p[k + 1])
        for column, blob in zip(blobs, (pack_sorted(words[w]), pack(uni[w]), pack_sorted(pairs[p]), pack(bi[p])), strict=True):
            column.append(blob)
    columns = [pa.array(range(low, low + fan), pa.int64()), pa.array([group] * fan, pa.int64()), pa.array([sender] * fan)]
    columns += [pa.array(b, pa.binary()) for b in blobs]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "grp", "sender", "words", "uni", "pairs", "bi"])


def _requests(batches: Iterator[pa.RecordBatch], fan: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Requests of chunks to the ranges of the first round; chunks of one group meet there."""
    for batch in batches:
        for row in batch.to_pylist():
            group = zlib.crc32(row["chunk"].encode()) % groups
            yield _cut(Chunk(row).distinct(), row["chunk"], group, 0, fan, fan)


def _asked(table: pa.Table, keys: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of all requests in a table, the place of each request's hashes among them, and where requests end."""
    asked = [unpack_sorted(b) for b in table[keys].to_pylist()]
    kinds, place = np.unique(np.concatenate(asked), return_inverse=True)
    return kinds, place, np.cumsum([len(a) for a in asked])[:-1]


def _summed(table: pa.Table, counts: str, place: np.ndarray, n: int) -> np.ndarray:
    own = np.concatenate([unpack(b) for b in table[counts].to_pylist()])
    return np.bincount(place, own, n).astype(np.uint64)


def _merged(table: pa.Table, level: int, fan: int) -> pa.Table:
    """Requests to finer ranges, of all requests of a group in one range taken together."""
    run = []
    for keys, counts in (("words", "uni"), ("pairs", "bi")):
        kinds, place, _ = _asked(table, keys)
        run += [kinds, _summed(table, counts, place, len(kinds))]
    bucket, group = table["bucket"][0].as_py(), table["grp"][0].as_py()
    return pa.Table.from_batches([_cut(tuple(run), f"{bucket}-{group}", group // fan, bucket * fan, fan, fan ** (level + 1))])


def _totals(table: pa.Table) -> pa.Table:
    """Replies of a bucket: for each sender the corpus counts of what it asked for; tokens and types once, with no sender."""
    replies = {}
    for keys, counts in (("words", "uni"), ("pairs", "bi")):
        kinds, place, ends = _asked(table, keys)
        total = _summed(table, counts, place, len(kinds))
        replies[counts] = [pack(part) for part in np.split(total[place], ends)]
        if keys == "words":
            real = kinds != START
            n_tokens, n_types = int(total[real].sum()), int((total[real] > 0).sum())
    n = len(table)
    return pa.table(
        {
            "bucket": pa.array([table["bucket"][0].as_py()] * (n + 1), pa.int64()),
            "sender": pa.array([*table["sender"].to_pylist(), None], pa.string()),
            "uni": pa.array([*replies["uni"], b""], pa.binary()),
            "bi": pa.array([*replies["bi"], b""], pa.binary()),
            "n_tokens": pa.array([0] * n + [n_tokens], pa.int64()),
            "n_types": pa.array([0] * n + [n_types], pa.int64()),
        }
    )


def _passed_back(asked: pa.Table, replies: pa.Table) -> pa.Table:
    """Replies to those whose requests were taken together, from the replies to the whole."""
    replies = replies.sort_by("bucket")
    out = {}
    for keys, counts in (("words", "uni"), ("pairs", "bi")):
        _, place, ends = _asked(asked, keys)
        total = np.concatenate([unpack(b) for b in replies[counts].to_pylist()])
        out[counts] = pa.array([pack(part) for part in np.split(total[place], ends)], pa.binary())
    return pa.table({"bucket": asked["bucket"], "sender": asked["sender"], **out})


def _ask(packed: DataFrame, size: int) -> tuple[DataFrame, int, int]:
    """(bucket, sender, uni, bi) replies for every chunk, and the numbers of tokens and types of the training texts."""
    n, fan = rounds(size)
    groups = max(1, math.ceil(packed.count() / fan)) if n > 1 else 1  # the last round has one group

    def merging(level: int):
        return lambda table: _merged(table, level, fan)

    asked = [packed.mapInArrow(lambda it: _requests(it, fan, groups), REQUEST)]
    for level in range(1, n):
        asked[-1] = stored(asked[-1], "lm-asked")
        asked.append(asked[-1].groupBy("bucket", "grp").applyInArrow(merging(level), REQUEST))
    replies = stored(asked.pop().groupBy("bucket").applyInArrow(_totals, f"{REPLY}, n_tokens long, n_types long"), "lm-replies")
    tokens, types = (int(x or 0) for x in replies.agg(F.sum("n_tokens"), F.sum("n_types")).first())
    replies = replies.filter("sender IS NOT NULL").select("bucket", "sender", "uni", "bi")
    while asked:
        level = asked.pop().withColumn("node", F.concat_ws("-", "bucket", "grp"))
        nodes = replies.withColumnRenamed("sender", "node")
        replies = level.groupBy("node").cogroup(nodes.groupBy("node")).applyInArrow(_passed_back, REPLY)
    return replies, tokens, types


def _counts(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of each token, of its context and of the two together."""
    chunk = Chunk(row)
    replies = sorted(row["replies"], key=lambda r: r["bucket"])
    words, _, pairs, _ = chunk.distinct()
    uni = np.concatenate([unpack(r["uni"]) for r in replies]).astype(np.float64)
    bi = np.concatenate([unpack(r["bi"]) for r in replies]).astype(np.float64)
    both = bi[np.searchsorted(pairs, bigram_hashes(chunk.context, chunk.token))]
    return chunk, uni[np.searchsorted(words, chunk.token)], uni[np.searchsorted(words, chunk.context)], both


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole part of the logarithm to base 2."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), CONTEXTS - 1).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch], n: int, v: int) -> Iterator[pa.RecordBatch]:
    """Training tokens by context bucket and by how much more likely bigram and unigram make them than the uniform
    distribution does, each token's own occurrence deleted from the counts."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk, word, context, both = _counts(row)
            word, context, both = (x[chunk.learn] - 1 for x in (word, context, both))
            bucket = context_bucket(context)
            ratio2 = both / np.maximum(context, 1) * (v + 1)
            ratio1 = word / max(n - 1, 1) * (v + 1)
            steps = [np.where(r > 0, np.clip(np.round(np.log2(np.maximum(r, 1e-12)) * STEPS), -400, 400), -401) for r in (ratio2, ratio1)]
            cell = (bucket * 1024 + steps[0].astype(np.int64) + 512) * 1024 + steps[1].astype(np.int64) + 512
            kinds, place = np.unique(cell, return_inverse=True)
            columns = [
                pa.array(kinds, pa.int64()),
                *[pa.array(np.bincount(place, w, len(kinds)), pa.float64()) for w in (np.ones(len(cell)), ratio2, ratio1)],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "ratio2", "ratio1"])


def mixture_weights(bucket: np.ndarray, n: np.ndarray, ratio2: np.ndarray, ratio1: np.ndarray) -> np.ndarray:
    """EM per context bucket: a row (bigram, unigram, uniform) of weights that sum to 1. ``n`` tokens each have the mean
    likelihood ratios to the uniform distribution. Buckets without tokens get the weights of all tokens together."""

    def learn(pick: np.ndarray) -> np.ndarray:
        like = np.stack([ratio2[pick], ratio1[pick], np.ones(pick.sum())], 1)
        weight = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = like * weight
            share /= share.sum(1, keepdims=True)
            weight = (share * n[pick, None]).sum(0) / n[pick].sum()
            weight = np.maximum(weight, 1e-9) / np.maximum(weight, 1e-9).sum()
        return weight

    if not len(n):
        return np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    all_ = learn(np.ones(len(n), bool))
    return np.stack([learn(bucket == b) if (bucket == b).any() else all_ for b in range(CONTEXTS)])


def token_probability(word, context, both, n: int, v: int, weights: np.ndarray) -> np.ndarray:
    """Mixture of bigram, unigram and uniform estimates, by the bucket of the context's frequency. Where the context was
    never seen, its share goes to the other two."""
    w = weights[context_bucket(context)]
    p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
    return np.where(context > 0, p, p / np.maximum(1 - w[:, 0], 1e-9))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Words are runs without white space, A-Z lower-cased, with one end token per text; texts whose id has CRC-32
    remainder 0 (and those without an id) are not learned from. Null texts are empty ones: an end token alone. Repeated
    rows count as often as they stand; an empty table gives no rows. ``base_score`` is the unigram model with 0.1 added.
    EM sees the counts in cells a quarter of an octave wide (``STEPS``), which moves a score by less than 1 % of itself. Words and bigrams
    are told apart by 55 and 56 bits of hash: a billion types have about a dozen pairs that are taken for one.
    """
    size = docs.agg(F.sum(F.octet_length(whole_text(text_col)) + 8)).first()[0] or 0
    packed = chunks(docs, id_col, text_col, folds)
    replies, n, v = _ask(packed, size)
    # A chunk gets one reply per range of the first round.
    per_chunk = replies.groupBy(F.col("sender").alias("chunk")).agg(F.collect_list(F.struct("bucket", "uni", "bi")).alias("replies"))
    counted = stored(packed.join(per_chunk, "chunk"), "lm-counted")

    cells = counted.mapInArrow(lambda it: _cells(it, n, v), "cell long, n double, ratio2 double, ratio1 double")
    # At most CONTEXTS * 802 * 802 cells and in fact some thousands, whatever the corpus.
    sums = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ratio2").alias("r2"), F.sum("ratio1").alias("r1")).orderBy("cell")
    sums = sums.toPandas()
    count = sums["n"].to_numpy(float)
    weights = mixture_weights(sums["cell"].to_numpy(np.int64) >> 20, count, sums["r2"].to_numpy(float) / count, sums["r1"].to_numpy(float) / count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                chunk, word, context, both = _counts(row)
                texts = len(chunk.ids)
                base = np.log10((word + ADD) / (n + ADD * (v + 1)))
                score = np.log10(token_probability(word, context, both, n, v, weights))
                columns = [
                    pa.array(chunk.ids, id_type),
                    pa.array(chunk.held, pa.bool_()),
                    pa.array(chunk.n_tokens, pa.int64()),
                    pa.array(np.bincount(chunk.text, word > 0, texts).astype(np.int64), pa.int64()),
                    pa.array([n] * texts, pa.int64()),
                    pa.array(np.bincount(chunk.text, base, texts), pa.float64()),
                    pa.array(np.bincount(chunk.text, score, texts), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted.mapInArrow(run, f"{id_col} {kind}, {shape}")
