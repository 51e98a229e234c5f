"""Exact duplicates by a tree merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import join_hot, stored, whole_text

FAN_IN = 16
# Digests a lane of the merged run holds at most about, if all texts differ.
LANE_ROWS = 1 << 20

# What must agree before two entries of a run are one text: SHA-256, a second hash of its own kind, and the length.
SAME = ("digest", "check", "n_bytes")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, SHA-256, second hash and byte length of its text, the partition it lies in and a row tag."""
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.xxhash64(text.cast("binary")).alias("check"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("leaf"),
        F.monotonically_increasing_id().alias("tag"),
    )


def lane_of(digest: str, bits: int) -> Column:
    """The leading ``bits`` bits of a digest: a lane is a range of digests, and lanes are even, as digests are."""
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.shiftright(head, 32 - bits)


def merge_runs(
    rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN, lane_rows: int = LANE_ROWS
) -> DataFrame:
    """Merge the partitions' sorted digest runs up a tree; the root has one row per text: digest, check, n_bytes, kept row, size.

    A run is sorted by digest and holds each text of its partition once, with the id to keep and a count; equal texts of a
    partition meet in the map task, before anything is sent. In a round of stride s, run k goes to run k - k % s, so ``fan_in``
    runs meet; with a fan-in of two these are the rounds of a binomial tree, with more, as many of those in one. What is
    exchanged are slices of runs, cut by lane (a range of digests), so the root is no single task's load. The receiver
    brings its slices into one order and goes through it once; neighbours are one text only if digest, second
    hash and length all agree, and of those the id to keep stays. A text that fills a third of all rows is one
    entry per run. The sorting is the one that Spark's sorted aggregation asks for.
    """
    best = F.max if keep == "largest" else F.min
    # Of repeated ids, the row with the smallest tag stays.
    tag = -F.col("tag") if keep == "largest" else F.col("tag")
    last, total = rows.agg(F.max("leaf"), F.count(F.lit(1))).first()
    bits = min((total // lane_rows).bit_length(), 31)

    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("lane", "run", *SAME).agg(best("first").alias("first"), F.sum("n").alias("n"))

    entry = [*SAME, F.struct("id", tag.alias("tag")).alias("first"), F.lit(1).cast("long").alias("n")]
    runs = merged(rows.select(lane_of("digest", bits).alias("lane"), F.col("leaf").alias("run"), *entry))
    stride = 1
    while stride < (last or 0) + 1:
        stride *= fan_in
        sent = runs.withColumn("run", F.col("run") - F.col("run") % stride)
        runs = merged(sent.repartition("lane", "run"))
    return runs.drop("lane", "run")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = FAN_IN
) -> DataFrame:
    """Group equal texts: one row (id, keep_id, group_size, kept, text_sha256) per row of ``docs``.

    ``keep`` says whether the row with the smallest or the largest id of a group stays. Null texts are empty texts.
    A null id is a smallest id for ``largest`` and for ``smallest``. Of rows equal in id and text exactly one is
    ``kept``. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    rows = stored(digest_rows(docs, id_col, text_col), "digests")
    root = stored(merge_runs(rows, keep, fan_in), "digest-root")
    sign = -1 if keep == "largest" else 1
    return join_hot(rows, root, list(SAME), "n").select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("tag") * sign == F.col("first.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
