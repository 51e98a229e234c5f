"""Repeated passages across documents, by prefix-partitioned sparse suffix trees.

A window of 20 words is looked up at one suffix only: the one that begins at its anchor, the six-word run of the least hash in
it. Equal windows have the same anchor, so the suffixes with one six-word prefix hold every copy of their windows. First only
prefixes are counted; a prefix that stands once has no repeat and its text is never sent. The others form groups, each
with its windows' texts; a prefix that too many suffixes share is lengthened to the whole window. In a group the suffixes
are ranked by their first 1, 2, 4, 8, 16 and 20 words; suffixes of one rank at depth 20 hang below one deep inner node of the
suffix tree, whose leaves are the copies of a repeat. All but the first leaf are removed.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import stored, whole_text
from logweave.llm.words import Rolling, Words, text_slices

DEPTH = 20
PREFIX = 6
# A prefix that more suffixes share is lengthened to a whole window.
GROUP_SUFFIXES = 50_000
# Words of the groups that one tree is built over at a time; distinct windows a task holds back to merge copies.
TREE_WORDS = 1_500_000
HELD_BACK = 100_000
NO_ID = (1 << 63) - 1

_ROLL = Rolling(seed=47)


class Suffixes:
    """Anchored suffixes of the texts of a slice. Per run of neighbouring windows with one anchor: ``text``, ``anchor`` (word
    place in the text), ``prefix`` (hash of the words at the anchor), ``start`` (first window, word place in the slice) and
    ``count`` of windows."""

    def __init__(self, words: Words, depth: int = DEPTH, prefix: int = PREFIX):
        hashes = _ROLL.words(words)
        n = len(hashes)
        none = np.zeros(0, np.int64)
        self.text = self.anchor = self.start = self.count = none
        self.prefix = np.zeros(0, np.uint64)
        if n < depth:
            return
        at = np.arange(n - prefix + 1)
        grams = _ROLL.runs(hashes, at, at + prefix)
        # Of equal hashes the leftmost counts: the place fills the low bits.
        low = np.uint64(n.bit_length())
        mask = (np.uint64(1) << low) - np.uint64(1)
        least, width = (grams & ~mask) | at.astype(np.uint64), 1
        target = depth - prefix + 1
        while width < target:
            step = min(width, target - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        window = np.flatnonzero(text[: n - depth + 1] == text[depth - 1 :])
        if not len(window):
            return
        anchor = (least[window] & mask).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
        self.start, self.count = window[new], np.diff(np.append(new, len(window)))
        self.text = text[self.start]
        self.prefix, self.anchor = grams[anchor[new]], anchor[new] - words.first[self.text]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, doc, anchor) of every suffix."""
    for batch in batches:
        doc = np.asarray(batch["doc"])
        for i, _, words in text_slices(batch["text"]):
            found = Suffixes(words)
            columns = [found.prefix.view(np.int64), doc[i + found.text], found.anchor.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["prefix", "doc", "anchor"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the shared suffixes: (key, id, doc, start, count, content). Of equal contents in one task only the first in
    corpus order is sent; the others are known to be repeats and are reported without content."""
    held: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
    rows: list[tuple] = []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = ["key", "id", "doc", "start", "count", "content"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def add(key: int, place: tuple[int, int, int, int], content: bytes) -> None:
        first = held.setdefault((key, content), place)
        if first != place:
            held[key, content] = min(first, place)
            rows.append((int(max(first, place)[1]), *max(first, place), None))

    for batch in batches:
        ids, docs, wanted = (batch[c].to_pylist() for c in ("id", "doc", "shared"))
        for i, _, words in text_slices(batch["text"]):
            found = Suffixes(words)
            lists = [{p >> 1: p & 1 for p in wanted[i + k] or ()} for k in range(len(words.first) - 1)]
            buffer, begin, end = words.joined()
            runs = zip(*(x.tolist() for x in (found.text, found.anchor, found.prefix.view(np.int64), found.start, found.count)), strict=True)
            for text, anchor, prefix, start, count in runs:
                long = lists[text].get(anchor)
                if long is None:
                    continue
                id_, doc, first = ids[i + text], docs[i + text], int(words.first[text])
                if not long:
                    add(prefix, (id_, doc, start - first, count), buffer[begin[start] : end[start + count + DEPTH - 2]])
                else:
                    for k in range(start, start + count):
                        content = buffer[begin[k] : end[k + DEPTH - 1]]
                        key = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)
                        add(key, (id_, doc, k - first, 1), content)
            if len(held) + len(rows) >= HELD_BACK:
                yield out(rows + [(key, *place, content) for (key, content), place in held.items()])
                held, rows = {}, []
    yield out(rows + [(key, *place, content) for (key, content), place in held.items()])


def deep_nodes(word: np.ndarray, leaves: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each suffix of ``word`` that begins at one of ``leaves``, the number of its tree node at ``depth`` words."""
    rank, width = word.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        following = np.concatenate([rank[step:], np.full(step, -1)]) + 1
        rank, width = np.unique(rank * (int(following.max()) + 1) + following, return_inverse=True)[1], width + step
    return rank[leaves]


def _tree_repeats(rows: list[np.ndarray], contents: pa.Array) -> list[np.ndarray]:
    """Windows that are not the first leaf of their node, as (id, doc, start, count) runs."""
    key, id_, doc, start, count = rows
    words = next(text_slices(contents, limit=1 << 62))[2]
    buffer, begin, end = words.joined()
    offsets = np.append(begin, len(buffer)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    node = deep_nodes(np.asarray(coded.indices), words.first[row] + place)
    at = start[row] + place
    order = np.lexsort((at, doc[row], id_[row], node, key[row]))
    same = (node[order][1:] == node[order][:-1]) & (key[row][order][1:] == key[row][order][:-1])
    repeat = np.zeros(len(row), bool)
    repeat[order[1:][same]] = True
    gone = np.flatnonzero(repeat)
    if not len(gone):
        return [np.zeros(0, np.int64)] * 4
    new = np.flatnonzero(np.concatenate([[True], (row[gone][1:] != row[gone][:-1]) | (place[gone][1:] != place[gone][:-1] + 1)]))
    size = np.diff(np.append(new, len(gone)))
    return [id_[row[gone[new]]], doc[row[gone[new]]], at[gone[new]], size]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over whole groups, some groups at a time; rows come sorted by key. Rows without content are repeats already."""

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        kinds = [np.int64, np.int64, np.int32, np.int32]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(c).astype(k)) for c, k in zip(columns, kinds, strict=True)], ["id", "doc", "start", "count"]
        )

    names = ["key", "id", "doc", "start", "count"]
    waiting: list[pa.RecordBatch] = []
    size = 0

    def build(table: pa.Table) -> pa.RecordBatch:
        return out(_tree_repeats([table[c].to_numpy() for c in names], table["content"].combine_chunks()))

    for batch in batches:
        known = batch["content"].is_null()
        done = batch.filter(known)
        if len(done):
            yield done.select(["id", "doc", "start", "count"])
        batch = batch.filter(pc.invert(known))
        if not len(batch):
            continue
        waiting.append(batch)
        size += int(np.asarray(batch["count"]).sum()) + DEPTH * len(batch)
        if size >= TREE_WORDS:
            table = pa.Table.from_batches(waiting).combine_chunks()
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield build(table.slice(0, cut))
            rest = table.slice(cut)
            waiting, size = rest.to_batches(), int(rest["count"].to_numpy().sum()) + DEPTH * len(rest)
    if waiting:
        yield build(pa.Table.from_batches(waiting).combine_chunks())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the removed words: (doc_id, n_words, n_removed, kept)."""
    for batch in batches:
        gone = batch["gone"].to_pylist()
        for i, j, words in text_slices(batch["text"]):
            change = np.zeros(len(words) + 1, np.int64)
            for k in range(i, j):
                for span in gone[k] or ():
                    at = int(words.first[k - i]) + span["start"]
                    change[at] += 1
                    change[at + span["count"] + DEPTH - 1] -= 1
            keep = np.cumsum(change[:-1]) == 0
            buffer, begin, end = words.joined()
            kept, n_words, n_removed = [], [], []
            for k in range(j - i):
                a, b = int(words.first[k]), int(words.first[k + 1])
                inner = keep[a:b]
                if inner.all():
                    text = buffer[begin[a] : end[b - 1]] if b > a else b""
                else:
                    # Runs of kept words are copied as they stand.
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], inner.view(np.int8), [0]])))
                    text = b" ".join(buffer[begin[a + x] : end[a + y - 1]] for x, y in zip(edge[::2], edge[1::2], strict=True))
                kept.append(text.decode())
                n_words.append(b - a)
                n_removed.append(b - a - int(inner.sum()))
            columns = [batch["doc_id"].slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of ``docs`` (doc_id integer, text): words covered by a window of 20 words
    that also begins earlier in the corpus are removed; kept words are joined by one blank.

    Earlier is a smaller doc_id, or an earlier place in the same text; texts of one doc_id are ordered by a hash of the text,
    rows equal in both are one document and share its result; null ids come last. Null texts have no words. An empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), whole_text("text").alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("id", "text"))

    places = rows.select("doc", "text").mapInArrow(_anchors, "prefix long, doc long, anchor int")
    counts = places.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    place = F.col("anchor").cast("long") * 2 + (F.col("n") > GROUP_SUFFIXES).cast("long")
    shared = places.join(counts, "prefix").groupBy("doc").agg(F.collect_set(place).alias("shared"))
    shared = stored(shared, "repeat-anchors")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # One exchange of the texts serves both joins below.
    texts = rows.repartition(parts, "doc")
    contents = texts.join(shared, "doc").select("id", "doc", "text", "shared")
    contents = contents.mapInArrow(_contents, "key long, id long, doc long, start int, count int, content binary")
    groups = contents.repartition("key").sortWithinPartitions("key")
    repeats = groups.mapInArrow(_trees, "id long, doc long, start int, count int")
    gone = repeats.groupBy("doc", "id").agg(F.collect_set(F.struct("start", "count")).alias("gone")).withColumnRenamed("id", "own")
    met = texts.join(gone, (texts["doc"] == gone["doc"]) & (texts["id"] == gone["own"]), "left").select("doc_id", "text", "gone")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
