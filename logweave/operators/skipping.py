"""Search that skips: entries stored in blocks, and per block the trigrams of its text as bitmaps.

A literal can only stand in a block whose bitmaps hold all of its trigrams. Blocks are partition folders, so the scan leaves
the others out (dynamic partition pruning) before a regex sees any row. The bitmaps may let a block through that has no match,
never the other way round: the match itself is always tested on the rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import small_side

BLOCK_ROWS = 1_000_000
# Rows that a task writes where blocks are smaller; tasks report to the driver, and small blocks must not be a task each.
TASK_ROWS = 100_000
# Places a trigram can have in a block's index, and the part of them that one bitmap of Spark's aggregate holds.
PLACE_BITS = 20
BITMAP_BITS = 15

BLOCK = "search_block"


def _lines(text: Column) -> Column:
    """Lines in lower case as case-insensitive patterns see them: A to Z only."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), "\n")


def _places(text: DataFrame) -> DataFrame:
    """The places of the trigrams in the lines of ``text``, without repeats per other column; no trigram holds a line end."""
    other = [c for c in text.columns if c != "lines"]
    lines = text.select(*other, F.explode("lines").alias("line"))
    trigrams = lines.select(*other, F.explode(F.regexp_extract_all("line", F.lit("(?=(...))"), F.lit(1))).alias("trigram"))
    place = F.pmod(F.xxhash64("trigram"), F.lit(1 << PLACE_BITS)).cast("int")
    return trigrams.select(*other, place.alias("place")).distinct()


def store_searchable(
    entries: DataFrame, path: str, text: Sequence[Column], order: Sequence[str], block_rows: int = BLOCK_ROWS
) -> None:
    """Write entries in blocks of about ``block_rows`` rows along ``order``, and the trigram index of the ``text`` columns.

    The index takes at most ``2 ** PLACE_BITS`` bits a block. Distinct trigrams are gathered in the map tasks, which read
    whole blocks, so little is shuffled. Null texts count as empty; an empty table gives an empty index.
    """
    if BLOCK in entries.columns:
        raise ValueError(f"column {BLOCK} is taken")
    rows = entries.count()
    blocks = rows // block_rows + 1
    ranges = min(blocks, rows // TASK_ROWS + 1)
    # A range that stands for several blocks is cut by the place of a row in it.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    inside = F.floor(place / F.lit(-(-rows // blocks))) if ranges < blocks else F.lit(0)
    block = F.shiftleft(F.spark_partition_id().cast("long"), 32) + inside
    placed = entries.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(BLOCK, block)
    placed.sortWithinPartitions(BLOCK, *order).write.partitionBy(BLOCK).parquet(f"{path}/entries")
    # An empty table leaves no file in its folders to tell the columns.
    placed.filter(F.lit(False)).write.parquet(f"{path}/columns")

    kept = _stored(entries.sparkSession, path)
    places = _places(kept.select(BLOCK, F.flatten(F.array(*[_lines(t) for t in text])).alias("lines")))
    bitmaps = places.groupBy(BLOCK, F.shiftright("place", BITMAP_BITS).alias("bitmap")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << BITMAP_BITS) - 1).cast("long")).alias("bits")
    )
    bitmaps.repartitionByRange("bitmap", BLOCK).sortWithinPartitions("bitmap", BLOCK).write.parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/entries")


def blocks_with(spark: SparkSession, path: str, literal: str) -> DataFrame | None:
    """Blocks that can hold the literal, or None if it has no trigram to look for.

    Only the bitmaps that the literal's trigrams lie in are read; they are sorted by number, so the others are skipped.
    """
    wanted = defaultdict(list)
    for r in _places(spark.range(1).select(_lines(F.lit(literal)).alias("lines"))).collect():
        wanted[r["place"] >> BITMAP_BITS].append(r["place"] & ((1 << BITMAP_BITS) - 1))
    if not wanted:
        return None

    def bit(k: int) -> Column:
        byte = F.conv(F.hex(F.substring("bits", k // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(1 << (k % 8)) != 0

    held = [(F.col("bitmap") == b) & reduce(lambda x, y: x & y, map(bit, sorted(ks))) for b, ks in sorted(wanted.items())]
    index = spark.read.parquet(f"{path}/index").filter(F.col("bitmap").isin(*sorted(wanted)))
    found = index.filter(reduce(lambda x, y: x | y, held)).groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") == len(wanted)).select(BLOCK)


def searchable(spark: SparkSession, path: str, literal: str) -> DataFrame:
    """The stored entries of all blocks that can hold ``literal`` (in either case of A to Z) in one of the indexed columns.

    Apply the match to the result, for example with ``text_match``, ``count_matches`` or ``find_next``. The literal has to be
    part of every match; a regex with a fixed part can be searched by that part. A literal whose lines have less than three
    characters reads everything.
    """
    entries = _stored(spark, path)
    blocks = blocks_with(spark, path, literal)
    if blocks is not None:
        entries = entries.join(small_side(blocks) or blocks, BLOCK, "left_semi")
    return entries.drop(BLOCK)
