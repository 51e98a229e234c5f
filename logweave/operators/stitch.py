"""Multi-line stitching: physical lines to logical entries, in bounded chunks.

The lines of a source are cut into chunks of ``2 ** chunk_bits`` line ids. Lines are shuffled once, by
chunk, so one large source is stitched by many tasks. An entry that lies inside one chunk is done there.
Only the first and last piece of a chunk can belong to an entry that crosses a chunk border; those few
pieces are joined across chunks in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16
# Text of one entry above this size goes on in further rows (part 1, 2, ...), since one string cannot grow forever.
MAX_PART_BYTES = 256 * 1024 * 1024

_CHUNK = ("source_path", "block_start", "chunk")


def _listagg(text: str, order: str) -> Column:
    return F.expr(f"listagg({text}, '\\n') within group (order by {order})")


def _joined(lines: DataFrame, by: list[str], way: str) -> DataFrame:
    return lines.groupBy(*by).agg(
        _listagg("value", f"line_id {way}").alias("raw"),
        F.min("line_id").alias("line_id"),
    )


def stitch(
    lines: DataFrame,
    is_start: str = "is_start",
    keep: tuple[str, ...] = ("source",),
    chunk_bits: int = CHUNK_BITS,
    max_part_bytes: int = MAX_PART_BYTES,
    closing: bool = False,
) -> DataFrame:
    """Join each line that does not start an entry to the entry before it.

    ``lines`` needs the line key, ``value`` and the boolean column ``is_start``. Lines before the first
    start of a source form one header entry. The result has one row per entry: the key of its first line,
    the columns in ``keep`` (constant per source), ``raw`` with the lines joined by ``\\n``, ``headed``
    (false for a header), ``part`` (0 except for entries above ``max_part_bytes``) and ``head``, the entry's first line in
    its rows after part 0, null elsewhere.

    With ``closing`` the flag marks the last line of an entry instead: each line is joined to the next
    flagged one, the key is that of the flagged line, and unflagged lines at the end are the headless rest.
    """
    if closing:
        flip = {"block_start": -F.col("block_start"), "line_id": -F.col("line_id")}
        lines = lines.withColumns(flip)
    way = "desc" if closing else "asc"
    keep = tuple(c for c in keep if c not in _CHUNK)
    # Keys that cannot be null keep the join below from adding null filters to some branches only, so that
    # all branches share one shuffle of the lines.
    line_id = F.coalesce(F.col("line_id"), F.lit(0).cast("long"))
    chunked = lines.select(
        F.coalesce("source_path", F.lit("")).alias("source_path"),
        F.coalesce("block_start", F.lit(0).cast("long")).alias("block_start"),
        F.shiftright(line_id, chunk_bits).alias("chunk"),
        line_id.alias("line_id"),
        *keep,
        "value",
        F.when(F.col(is_start), F.col("line_id")).alias("start_id"),
    )
    chunk = Window.partitionBy(*_CHUNK)
    in_order = chunk.orderBy("line_id")
    runs = chunked.withColumns(
        {
            "first_line": F.max("start_id").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
            "next_start": F.lead("start_id").over(in_order),
        }
    ).withColumn("last_start", F.max("start_id").over(chunk))
    closed = F.col("first_line").isNotNull() & (F.col("first_line") < F.col("last_start"))
    by = [*_CHUNK, *keep, "first_line"]

    # Most entries are one line between two starts; only the others need an aggregate.
    single = F.col("start_id").isNotNull() & F.col("next_start").isNotNull()
    whole = [*_CHUNK[:2], "line_id", *keep, "raw", F.lit(True).alias("headed"), F.lit(0).alias("part"),
             F.lit(None).cast("string").alias("head")]
    one_line = runs.filter(single).withColumnRenamed("value", "raw").select(*whole)
    inside = one_line.unionByName(_joined(runs.filter(closed & ~single), by, way).select(*whole))

    pieces = _joined(runs.filter(~closed | closed.isNull()), by, way).withColumn("tail", F.col("first_line").isNotNull())
    # Owner of a piece: the last start at or before it. Only keys, sizes and first lines go through this per-source window.
    path = Window.partitionBy("source_path").orderBy("block_start", "chunk", "tail")
    before = path.rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("tail"), F.struct("block_start", "line_id"))
    owners = pieces.select(
        *_CHUNK,
        "tail",
        F.last(start, ignorenulls=True).over(before).alias("owner"),
        F.first(F.struct("block_start", "line_id")).over(before).alias("source_head"),
        (F.octet_length("raw") + 1).cast("long").alias("size"),
        F.when(F.col("tail"), F.substring_index("raw", "\n", 1)).alias("line"),
    )
    growing = Window.partitionBy("source_path", "owner").orderBy("block_start", "chunk", "tail")
    offset = F.coalesce(F.sum("size").over(growing.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owners = owners.withColumns(
        {
            "part": F.floor(offset / F.lit(max_part_bytes)).cast("int"),
            "head": F.first("line").over(growing.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).drop("size", "line")
    # The owners of a chunk's pieces side by side: the join is by chunk, as the pieces lie, and their text is not shuffled for it.
    found = F.struct("owner", "source_head", "part", "head")
    sides = owners.groupBy(*_CHUNK).agg(
        F.min(F.when(F.col("tail"), found)).alias("of_tail"), F.min(F.when(~F.col("tail"), found)).alias("of_rest")
    )

    crossing = (
        pieces.join(sides, list(_CHUNK))
        .withColumn("found", F.when(F.col("tail"), F.col("of_tail")).otherwise(F.col("of_rest")))
        .select(*pieces.columns, "found.*")
        .withColumn("headed", F.col("owner").isNotNull())
        .withColumn("key", F.coalesce("owner", "source_head"))
        .groupBy("source_path", "key", "headed", "part", *keep)
        .agg(
            _listagg("raw", f"block_start {way}, chunk {way}, tail {way}").alias("raw"),
            F.min(F.when(F.col("part") > 0, F.col("head"))).alias("head"),
        )
        .select("source_path", "key.block_start", "key.line_id", *keep, "raw", "headed", "part", "head")
    )
    entries = inside.unionByName(crossing)
    return entries.withColumns(flip) if closing else entries
