"""Hard negatives by exact window search in a multiway hyperplane tree with distance ranges (GNAT).

Every row is lifted by one component so that all rows have one length; an anchor's inner product with a row is then a falling
function of their distance, and a window of scores is a ring (annulus) around the anchor. The tree's split points come from a
bounded sample, every row is indexed: it goes down to the nearest split point at each level. For each split point and each
sibling subtree the tree holds the smallest and largest distance over all rows below, so a ring that misses one of these
ranges skips the subtree. Leaves that are left are searched exactly, block by block, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import handed_in_batches, stored

# Rows that the tree is fitted on, at most, and bytes of their vectors; children of a node; sample rows of a leaf.
SAMPLE = 8192
SAMPLE_BYTES = 16 << 20
FAN = 12
LEAF = 48
# Rows of a leaf that are searched at once, anchors that search together, and blocks of a leaf that share a task.
BLOCK = 4096
CHUNK = 1000
TOGETHER = 16
# Scores that are looked at in one go, bytes of questions handed on at once, and bytes of a row group of tables with long rows.
CELLS = 1 << 18
SENT_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
# Open ends of a window of scores.
LOW, HIGH = -(1 << 62), 1 << 62
# A squared length below this keeps every inner product in 64 bits; rows beyond take no part.
LONGEST = float(1 << 62)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of whole numbers as a matrix; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten()).astype(np.int64)
    size = np.diff(np.asarray(column.offsets))
    if (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def products(a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``; floating point where every sum is a whole number below 2**53."""
    wide = _wide(longest)
    return (a.astype(wide, copy=False) @ b.astype(wide, copy=False).T).astype(np.int64, copy=False)


def _wide(longest: int) -> type:
    """Number type in which inner products are exact."""
    return np.float64 if longest < 1 << 53 else np.int64


@dataclass
class Node:
    """A split: its points, what lies below each (a node, or -1 - leaf), and the distance ranges [point, subtree]."""

    points: np.ndarray
    below: list[int] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    """Nodes (the first is the root; none if all is one leaf), the path of (node, child) to each leaf, and the sample."""

    dim: int
    longest: int
    nodes: list[Node]
    paths: list[list[tuple[int, int]]]
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @property
    def kind(self) -> str:
        """Number type in which vectors are stored: each component is at most the root of ``longest``."""
        return "<i2" if self.longest < 1 << 30 else "<i4"

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The further component that gives every row the squared length ``longest``."""
        return np.sqrt(np.maximum(float(self.longest) - np.einsum("ij,ij->i", *[x.astype(np.float64)] * 2), 0))

    def distances(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of lifted rows from lifted split points."""
        same = x.astype(np.float64) @ points.astype(np.float64).T + self.lift(x)[:, None] * self.lift(points)[None, :]
        return np.sqrt(np.maximum(2.0 * self.longest - 2.0 * same, 0))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        leaf = np.zeros(len(x), np.int32)
        open_ = [(0, np.arange(len(x)))] if self.nodes and len(x) else []
        while open_:
            k, rows = open_.pop()
            near = self.distances(x[rows], self.nodes[k].points).argmin(1)
            for child, below in enumerate(self.nodes[k].below):
                mine = rows[near == child]
                if len(mine) and below >= 0:
                    open_.append((below, mine))
                else:
                    leaf[mine] = -1 - below
        return leaf

    def spread(self, leaf: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest distance of a leaf's rows from all split points on the leaf's path, in order."""
        if not self.paths[leaf]:
            return np.zeros(0), np.zeros(0)
        d = np.hstack([self.distances(x, self.nodes[k].points) for k, _ in self.paths[leaf]])
        return d.min(0), d.max(0)

    def set_ranges(self, spreads: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Ranges over all rows, from those of each leaf; a subtree without rows keeps an empty range."""
        for node in self.nodes:
            n = len(node.points)
            node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for leaf, (low, high) in spreads.items():
            at = 0
            for k, child in self.paths[leaf]:
                node, n = self.nodes[k], len(self.nodes[k].points)
                node.low[:, child] = np.minimum(node.low[:, child], low[at : at + n])
                node.high[:, child] = np.maximum(node.high[:, child], high[at : at + n])
                at += n

    def leaves(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, anchors) for every leaf that can hold a row whose score with the anchor lies in the anchor's window."""
        own = np.einsum("ij,ij->i", *[q.astype(np.float64)] * 2) + float(self.longest)
        slack = 1e-6 * np.sqrt(own)
        outer = np.where(low <= LOW, np.inf, np.sqrt(np.maximum(own - 2.0 * low, 0)) + slack)
        inner = np.where(high >= HIGH, 0.0, np.sqrt(np.maximum(own - 2.0 * high, 0)) - slack)
        if not self.nodes:
            yield 0, np.arange(len(q))
            return
        open_ = [(0, np.arange(len(q)))]
        while open_:
            k, rows = open_.pop()
            node = self.nodes[k]
            # An anchor is lifted by zero: its distance from a lifted point follows from the inner product alone.
            d = np.sqrt(np.maximum(own[rows, None] - 2.0 * (q[rows].astype(np.float64) @ node.points.astype(np.float64).T), 0))
            alive = np.ones((len(rows), len(node.below)), bool)
            for i in range(len(node.points)):
                here = d[:, i, None]
                alive &= node.low[i] <= here + outer[rows, None]
                alive &= node.high[i] >= np.maximum(here - outer[rows, None], inner[rows, None] - here) - slack[rows, None]
            for child, below in enumerate(node.below):
                left = rows[alive[:, child]]
                if len(left) and below >= 0:
                    open_.append((below, left))
                elif len(left):
                    yield -1 - below, left


def fit(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, longest: int) -> Tree:
    """A tree over sample rows. Split points of a node are chosen far from each other, from three times as many candidates."""
    tree = Tree(vectors.shape[1], longest, [], [], ids, labels, vectors)
    rng = np.random.default_rng(11)

    def grow(rows: np.ndarray, path: list[tuple[int, int]]) -> int:
        distinct = np.unique(vectors[rows], axis=0) if len(rows) > LEAF else vectors[:0]
        if len(distinct) < 2:
            tree.paths.append(path)
            return -len(tree.paths)
        among = distinct[rng.permutation(len(distinct))[: 3 * FAN]]
        apart = tree.distances(among, among)
        chosen = [0]
        while len(chosen) < min(FAN, len(among)):
            far = apart[:, chosen].min(1)
            far[chosen] = -1
            chosen.append(int(far.argmax()))
        k = len(tree.nodes)
        node = Node(among[chosen])
        tree.nodes.append(node)
        near = tree.distances(vectors[rows], node.points).argmin(1)
        node.below = [grow(rows[near == c], [*path, (k, c)]) for c in range(len(chosen))]
        return k

    grow(np.arange(len(ids)), [])
    return tree


def first_hits(
    scores: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(window, row) of each window's first ``k`` allowed rows with a score in it: highest score, then smallest id."""
    inside = allowed & (scores >= low[:, None]) & (scores <= high[:, None])
    if 0 < k < scores.shape[1]:
        # Only rows that reach a window's k-th score are put in order.
        inside &= scores >= np.partition(np.where(inside, scores, LOW), -k, axis=1)[:, -k, None]
    q, x = np.nonzero(inside)
    order = np.lexsort((ids[x], -scores[q, x], q))
    q, x = q[order], x[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return q[place < k], x[place < k]


@dataclass
class Windows:
    """Windows of scores of some anchors: id, label and vector per anchor; per window its anchor's place, low and high."""

    anchor: np.ndarray
    label: np.ndarray
    v: np.ndarray
    slot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def hits(
        self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, same_label: bool, longest: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row, score) of each window's first ``k`` of the rows, by ``CELLS`` scores at once: memory does not grow with
        windows times rows."""
        vectors = vectors.astype(_wide(longest), copy=False)
        step = max(1, CELLS // max(1, len(ids)))
        found = [(np.zeros(0, np.int64),) * 3]
        for i in range(0, len(self.slot), step):
            mine, at = np.unique(self.slot[i : i + step], return_inverse=True)
            scores = products(self.v[mine], vectors, longest)
            allowed = (self.label[mine, None] == labels[None, :]) == same_label
            allowed &= self.anchor[mine, None] != ids[None, :]
            scores = scores[at]
            q, x = first_hits(scores, allowed[at], self.low[i : i + step], self.high[i : i + step], ids, k)
            found.append((q + i, x, scores[q, x]))
        return tuple(np.concatenate(c) for c in zip(*found))


def usable(vectors: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: whole-number vectors ``floor(256 * x)``."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), v.alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("squared", length).filter(F.col("squared") < LONGEST)


def _blocks(rows: DataFrame, sent) -> DataFrame:
    """Every row under its leaf, in blocks: leaf, ids, labels, vectors, and the ranges of distances from the leaf's path."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            x = matrix(batch["v"], tree.dim)
            packed = pa.array([r.tobytes() for r in x.astype(tree.kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree.route(x)), batch["vec_id"], batch["label"], packed], ["leaf", "vec_id", "label", "v"]
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            leaf = np.asarray(batch["leaf"])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]])
            ids, labels = np.asarray(batch["vec_id"]), np.asarray(batch["label"])
            made = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                raw = b"".join(batch["v"].slice(a, b - a).to_pylist())
                low, high = tree.spread(int(leaf[a]), np.frombuffer(raw, tree.kind).reshape(b - a, tree.dim))
                made.append((int(leaf[a]), ids[a:b].tobytes(), labels[a:b].tobytes(), raw, low.tolist(), high.tolist()))
            columns = list(zip(*made)) or [[]] * 6
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            names = ["leaf", "ids", "labels", "vectors", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    spark = rows.sparkSession
    with handed_in_batches(spark, BLOCK):
        placed = rows.mapInArrow(route, "leaf int, vec_id long, label long, v binary")
        # Ranges of (leaf, id) cut a leaf of any size over tasks; rows of a block are in the order of their ids.
        placed = placed.repartitionByRange("leaf", "vec_id").sortWithinPartitions("leaf", "vec_id")
        shape = "leaf int, ids binary, labels binary, vectors binary, low array<double>, high array<double>"
        return stored(placed.mapInArrow(pack, shape), "gnat-blocks", GROUP_BYTES)


def _search(blocks: DataFrame, parts: DataFrame, queries: DataFrame, sent, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, no, vec_id, score, place): the first ``k`` rows of each query's window, ``place`` from 1.

    ``queries`` has anchor_id, no, label, v, low and high. The sample raises a window's lower end to the score of its k-th
    hit there, which the result cannot lie below. ``parts`` has per leaf the number of tasks that share it.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            q = matrix(batch["v"], tree.dim)
            anchor, no, label, low, high = (np.asarray(batch[c]).astype(np.int64) for c in ("anchor_id", "no", "label", "low", "high"))
            # Windows of one anchor share its vector, here and in what is sent.
            anchors, one, slot = np.unique(anchor, return_index=True, return_inverse=True)
            vectors = q[one]
            asked = Windows(anchors, label[one], vectors, slot, low, high)
            a, _, score = asked.hits(tree.ids, tree.labels, tree.vectors, k, same_label, tree.longest)
            full = np.bincount(a, minlength=len(q)) == k
            last = np.full(len(q), HIGH)
            np.minimum.at(last, a, score)
            low = np.where(full, last, low)
            made, size = [], 0
            for leaf, rows in tree.leaves(q, low, high):
                mine, place = np.unique(slot[rows], return_inverse=True)
                columns = (anchors[mine], label[one[mine]], vectors[mine].astype(tree.kind))
                columns += (place.astype(np.int32), no[rows], low[rows], high[rows])
                made.append((leaf, *(c.tobytes() for c in columns)))
                size += sum(map(len, made[-1][1:]))
                if size >= SENT_BYTES:
                    yield questions(made)
                    made, size = [], 0
            if made:
                yield questions(made)

    def questions(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], [f"q{i}" for i in range(8)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            # Row by row: the numbers of one joined row at a time are taken out of the batch.
            for n in range(batch.num_rows):
                row = {c: batch[c][n].as_buffer() for c in ("ids", "labels", "vectors", *(f"q{i}" for i in range(1, 8)))}
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                x = np.frombuffer(row["vectors"], tree.kind).reshape(-1, tree.dim)
                anchor, label, no, low, high = (np.frombuffer(row[f"q{i}"], np.int64) for i in (1, 2, 5, 6, 7))
                v, slot = np.frombuffer(row["q3"], tree.kind).reshape(-1, tree.dim), np.frombuffer(row["q4"], np.int32)
                a, r, score = Windows(anchor, label, v, slot, low, high).hits(ids, labels, x, k, same_label, tree.longest)
                columns = [anchor[slot[a]], no[a], ids[r], score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "no", "vec_id", "score"])

    spark = queries.sparkSession
    with handed_in_batches(spark, CHUNK):
        asked = queries.select("anchor_id", "no", "label", "v", "low", "high")
        asked = asked.mapInArrow(ask, "q0 int, " + ", ".join(f"q{i} binary" for i in range(1, 8)))
        asked = stored(asked, "gnat-asked", GROUP_BYTES)
    # A leaf with many blocks is dealt to several tasks; the anchors that ask for it are sent to each of them.
    parts = F.broadcast(parts)
    dealt = blocks.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts"))).drop("parts", "low", "high")
    asked = asked.join(parts.withColumnRenamed("leaf", "q0"), "q0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # A merge join holds the rows of a key from its right side: there are about TOGETHER blocks of one, but any number of questions.
    met = asked.drop("parts").withColumnRenamed("q0", "leaf").join(dealt, ["leaf", "part"]).drop("leaf", "part")
    with handed_in_batches(spark, 8):
        found = stored(met.mapInArrow(scan, "anchor_id long, no long, vec_id long, score long"), "gnat-found")
    best = Window.partitionBy("anchor_id", "no").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int, int] = (30, 90, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    ``vectors`` has vec_id, embedding and label; other columns are not read. ``anchors`` chooses the anchors among the rows
    (default: ids divisible by 100). A row's score is its inner product with the anchor, vectors being taken as
    ``floor(256 * x)``. An anchor's positives are the first ``positives`` rows of its label, its negatives for one of them the
    first ``negatives`` rows of other labels with ``low * positive_score <= whole * negative_score <= high * positive_score`` (0 <= low <= high).
    Higher scores come first, then smaller ids.

    Rows without id, label or vector or with a null or non-finite component take no part, nor do rows whose squared
    length is 2**62 or more. Shorter vectors count as ending in zeros. Rows that share an id are rows on their own, but never
    partners of an anchor with this id; of anchors that share an id the one with the smallest (label, vector) counts. An
    anchor without positives gives no rows, a pair without negatives neither, an empty table none.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "gnat-rows")
    total = rows.agg(F.max("squared").alias("m"), F.max(F.size("v")).alias("dim")).first()
    dim, longest = int(total["dim"] or 1), int(total["m"] or 0) + 1
    dim = max(dim, 1)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("vec_id", "label", "v")
    table = some.toArrow().combine_chunks()
    tree = fit(np.asarray(table["vec_id"]), np.asarray(table["label"]), matrix(table["v"], dim), longest)
    blocks = _blocks(rows.select("vec_id", "label", "v"), spark.sparkContext.broadcast(tree))

    # Ranges per leaf: a few numbers for each of a bounded number of leaves.
    at = blocks.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
    at = at.groupBy("leaf", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    at = at.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("r"))
    tree.set_ranges({x["leaf"]: (np.array([y["low"] for y in x["r"]]), np.array([y["high"] for y in x["r"]])) for x in at.collect()})
    sent = spark.sparkContext.broadcast(tree)
    # Never more rows than the tree has leaves.
    parts = stored(blocks.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts")), "gnat-parts")

    chosen = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    asking = rows.filter(chosen).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a"))
    asking = asking.select("anchor_id", "a.label", "a.v")
    first = asking.withColumns({"no": F.lit(0), "low": F.lit(LOW), "high": F.lit(HIGH)})
    near = _search(blocks, parts, first, sent, positives, same_label=True)
    near = near.select("anchor_id", F.col("place").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stored(near, "gnat-positives")

    low, high, whole = window
    pair = near.join(asking, "anchor_id")
    more = F.col("positive_score") % whole
    pair = pair.filter("positive_score >= 0").withColumns(
        {
            "low": F.expr(f"positive_score div {whole}L") * low + F.ceil(more * low / whole),
            "high": F.expr(f"positive_score div {whole}L") * high + F.floor(more * high / whole),
        }
    )
    # Below zero there is no room between the two bounds.
    pair = pair.filter("low <= high").drop("positive_id", "positive_score")
    far = _search(blocks, parts, pair, sent, negatives, same_label=False)
    return far.join(near, ["anchor_id", "no"]).select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
