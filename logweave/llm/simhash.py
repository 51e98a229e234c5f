"""Near-duplicates by SimHash: fingerprints, a byte-position inverted index with count filter, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import fresh, join_hot, stored
from logweave.llm.components import components
from logweave.llm.words import text_slices

BYTES = 8
# Members of a posting list that are compared in one piece; longer lists are compared piece by piece.
PIECE = 4096


def fingerprint_texts(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text as unsigned numbers: A-Z lower-cased, word shingles with repeats, XXH64 each; a bit is
    set if it is in over half the hashes. A text with fewer words is one shingle; one with none gives 0."""
    out = np.zeros(len(column), np.uint64)
    for i, j, words in text_slices(column, lower=True):
        buffer, start, end = words.joined()
        count = np.diff(words.first)
        n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        if not n.sum():
            continue
        begin = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(words.first[:-1] - begin, n)
        last = np.minimum(at + shingle - 1, np.repeat(words.first[1:], n) - 1)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(buffer[a:b], seed) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)),
            np.uint64,
            len(at),
        )
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1)
        some = np.flatnonzero(n)
        ones = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n[some, None], axis=1)
        out[i + some] = packed.view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) per document; fp holds the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprint_texts(batch["text"], shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(prints)], ["id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp long")


def posting_sets(distance: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions, such that two fingerprints within ``distance`` bits agree on all of some set.

    Such two agree on at least 8 - distance bytes. Of any 5 of the 8 positions, 3 lie in one half, so for 3 bits the
    triples of each half do: 8 sets. Otherwise all sets of that width serve.
    """
    equal = BYTES - distance
    if width > equal:
        raise ValueError(f"{width} equal bytes are not certain at {distance} bits")
    half = BYTES // 2
    if 2 * (width - 1) < equal and width <= half:
        return [*combinations(range(half), width), *combinations(range(half, BYTES), width)]
    return list(combinations(range(BYTES), width))


def _spanning(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints within ``distance`` bits."""
    edges, left = [], prints
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = _linked(node ^ left, distance)
            found = left[near]
            edges += [(node, x) for x in found]
            queue.extend(found)
            left = left[~near]
    return edges


def _linked(x: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then verification: enough bytes of the difference are zero, and few enough bits are set."""
    alike = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - distance
    return alike & (np.bitwise_count(x) <= distance)


def _links(cells: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside each cell (rows sorted by cell). Cells of up to 16 give all their links, larger ones a spanning forest."""
    rest = None
    for batch in _with_end(cells):
        if batch is not None:
            part = [np.asarray(batch[c]) for c in ("key", "i", "j")] + [np.asarray(batch["fp"]).view(np.uint64)]
            rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        key, i, j, fp = rest
        change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        done = len(key) if batch is None else (change[-1] if len(change) else 0)
        rest = [x[done:] for x in rest]
        begin = np.concatenate([[0], change[change < done]])
        size = np.diff(np.append(begin, done))
        a, b = [], []
        small = np.repeat(np.where(size <= 16, size, 0), size)
        place = np.arange(done) - np.repeat(begin, size)
        for shift in range(1, 16):
            at = np.flatnonzero(small - place > shift)
            if not len(at):
                break
            at = at[_linked(fp[at] ^ fp[at + shift], distance)]
            a.append(fp[at])
            b.append(fp[at + shift])
        for k in np.flatnonzero(size > 16):
            edges = np.array(_spanning(fp[begin[k] : begin[k] + size[k]], distance), np.uint64).reshape(-1, 2)
            a.append(edges[:, 0])
            b.append(edges[:, 1])
        if a:
            both = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(both, ["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def linked_pairs(prints: DataFrame, distance: int = 3, width: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``prints`` (fp): enough of them that the components are exact.

    The index has a posting list for each set of byte positions and the values there. A byte alone would give lists of
    1/256 of all rows, so sets of ``width`` bytes are posted: 3, or 5 from 2**26 fingerprints on. Both find every pair. A long
    list is cut into pieces and each pair of pieces is compared in a task of its own; it gives a spanning forest, never all
    its pairs.
    """
    if width is None:
        width = min(BYTES - distance, 3 if prints.count() < 1 << 26 else 5)
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(BYTES)]
    keys = []
    for no, places in enumerate(posting_sets(distance, width)):
        key = F.lit(no)
        for k in places:
            key = key * 256 + byte[k]
        keys.append(key.cast("long"))
    posted = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    posted = posted.join(sizes, "key")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    cells = posted.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(lambda batches: _links(batches, distance), "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; component_id is the smallest id reachable over links of at most
    ``distance`` differing bits.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Null ids take part, but are never
    the smallest unless a component has no other. Repeated rows and ids are kept. An empty table gives no rows; other
    columns are not read. Copies of a fingerprint are joined once and never expanded to pairs.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    roots = components(linked_pairs(prints.select("fp"), distance))
    rooted = stored(
        prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")),
        "rooted",
    )
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = join_hot(rooted, stored(classes, "classes"), ["root"], "members")
    named = stored(named.select("fp", "n", "component_id"), "named")
    return join_hot(rows, named, ["fp"], "n").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that stay: of each component the one with the smallest doc_id.

    Of rows with that id exactly one stays, the first as they are stored; where a component has only null ids, one of
    those. Columns are unchanged.
    """
    names = docs.columns
    row, first = fresh("row", names), fresh("first", names)
    tagged = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-tagged")
    ids = tagged.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("doc_id"), "text")
    groups = simhash_groups(ids, shingle=shingle, distance=distance)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").getField(row).alias(first))
    return tagged.join(kept, F.col(row) == F.col(first), "left_semi").select(*[f"`{c}`" for c in names])
