"""Format detection per source, from the first 128 KiB of its text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.steps import Steps
from logweave.operators.formats import FALLBACK, FormatSet, LogFormat, default_formats
from logweave.operators.parse import _base, parse_lines
from logweave.operators.stitch import CHUNK_BITS, MAX_PART_BYTES
from logweave.session import attach, settle, small_side

HEAD_BYTES = 128 * 1024


def heads_of(lines: DataFrame, head_bytes: int = HEAD_BYTES, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The first ``head_bytes`` bytes of every source, one row per source: (source_path, head).

    Sizes are summed per chunk before the shuffle; only chunks that reach into the head send their lines on,
    so a large source costs no more than a small one.
    """
    chunk = ["source_path", "block_start", "chunk"]
    sized = lines.withColumn("chunk", F.shiftright(F.col("line_id"), chunk_bits)).withColumn(
        "size", (F.octet_length("value") + 1).cast("long")
    )
    order = Window.partitionBy("source_path").orderBy("block_start", "chunk")
    begin = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head_chunks = (
        sized.groupBy(*chunk)
        .agg(F.sum("size").alias("size"))
        .withColumn("chunk_begin", begin)
        .filter(F.col("chunk_begin") < head_bytes)
        .drop("size")
    )
    inside = Window.partitionBy(*chunk).orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("chunk_begin") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    head_chunks = settle(head_chunks)
    kept = (
        sized.join(small_side(head_chunks) or head_chunks, chunk)
        .withColumn("room", (F.lit(head_bytes) - offset).cast("int"))
        .filter(F.col("room") > 0)
    )
    # the line that crosses the border is cut at the byte, a torn character is replaced
    cut = F.make_valid_utf8(F.substr(F.col("value").cast("binary"), F.lit(1), F.col("room")).cast("string"))
    return (
        kept.withColumn("value", F.when(F.octet_length("value") > F.col("room"), cut).otherwise(F.col("value")))
        .groupBy("source_path")
        .agg(F.expr("listagg(value, '\\n') within group (order by block_start, line_id)").alias("head"))
    )


def score_formats(
    heads: DataFrame, formats: Sequence[LogFormat] | None = None, base_date=None, candidates_only: bool = False
) -> DataFrame:
    """Entry counts per (source, format) over the heads.

    Columns: source_path, format_index, candidate (the first line passes the format's test), timed and total
    entries. With ``candidates_only`` the other formats are not tried at all. The explode to lines needs no
    shuffle before the partial counts.
    """
    formats = list(formats if formats is not None else default_formats())
    keep = [c for c in ("base_date",) if c in heads.columns]
    # heads are small but every format reads them: a fixed number of partitions uses all cores
    spread = heads.repartition(heads.sparkSession.sparkContext.defaultParallelism, "source_path")
    text = F.split(F.regexp_replace("head", r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    first = F.regexp_extract("head", r"\A[^\r\n]*", 0)
    tests = F.array(*[F.struct(F.lit(i).alias("format_index"), f.first_line(F.col("first")).alias("candidate")) for i, f in enumerate(formats)])
    per_format = spread.withColumn("first", first).select("source_path", *keep, "head", F.inline(tests))
    used = None
    if candidates_only:
        per_format = per_format.filter("candidate")
        # The tests of the first lines alone, at most one row per format.
        used = [row.format_index for row in per_format.select("format_index").distinct().collect()]
    fmt = FormatSet(formats, F.col("format_index"), used)
    lines = per_format.select("source_path", *keep, "format_index", "candidate", F.posexplode(text).alias("pos", "value"))
    steps = Steps(lines)
    read = steps.let(fmt.fields(steps.let, F.col("value"), _base(lines, base_date)))
    flagged = steps.finish(is_start=read.isNotNull(), is_timed=F.coalesce(read["timestamp"].isNotNull(), F.lit(False)))
    header = ~F.max(F.when(F.col("pos") == 0, F.col("is_start")))
    return flagged.groupBy("source_path", "format_index", "candidate").agg(
        F.count_if("is_timed").alias("timed"),
        (F.count_if("is_start") + F.when(header, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("total"),
    )


def choose_format(scores: DataFrame) -> DataFrame:
    """The winning format per source: (source_path, format_index), :data:`FALLBACK` if none finds a timed entry.

    Candidates with timed entries go first, then more timed entries, more entries, and registry order.
    """
    best = F.struct(
        (F.col("candidate") & (F.col("timed") > 0)).alias("candidate"),
        "timed",
        "total",
        (-F.col("format_index")).alias("rank"),
        "format_index",
    )
    top = scores.groupBy("source_path").agg(F.max(best).alias("best"))
    chosen = F.when(F.col("best.timed") > 0, F.col("best.format_index")).otherwise(F.lit(FALLBACK))
    return top.select("source_path", chosen.cast("int").alias("format_index"))


def detect_formats(heads: DataFrame, formats: Sequence[LogFormat] | None = None, base_date=None) -> DataFrame:
    """(source_path, format_index) for every head.

    First only the formats that accept the first line are scored. Sources they do not settle, such as those
    with a header, are scored under all formats. ``heads`` should be settled: both rounds read it.
    """
    likely = settle(choose_format(score_formats(heads, formats, base_date, candidates_only=True)))
    known = likely.filter(F.col("format_index") != FALLBACK)
    left = heads.join(known, "source_path", "left_anti")
    return known.unionByName(choose_format(score_formats(left, formats, base_date)))


def parse_detected(
    lines: DataFrame,
    formats: Sequence[LogFormat] | None = None,
    detected: DataFrame | None = None,
    base_date=None,
    base_year: int | None = None,
    keep: tuple[str, ...] = (),
    chunk_bits: int = CHUNK_BITS,
    max_part_bytes: int = MAX_PART_BYTES,
) -> DataFrame:
    """Detect the format of every source and parse its lines.

    The detection result, one small row per source, is settled first and joined by broadcast while it is
    small, by a salted shuffle beyond.
    """
    formats = list(formats if formats is not None else default_formats())
    if detected is None:
        detected = detect_formats(settle(heads_of(lines, chunk_bits=chunk_bits)), formats, base_date)
    detected = settle(detected)
    # At most one row per format.
    used = [row.format_index for row in detected.select("format_index").distinct().collect()]
    known = attach(lines, detected, ["source_path"], how="inner")
    return parse_lines(
        known,
        FormatSet(formats, F.col("format_index"), used),
        base_date,
        base_year,
        keep=("format_index", *keep),
        chunk_bits=chunk_bits,
        max_part_bytes=max_part_bytes,
    )
