"""Text lines to typed entries under a known format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.steps import Steps
from logweave.operators.formats import LogFormat
from logweave.operators.stitch import CHUNK_BITS, MAX_PART_BYTES, stitch


def _base(df: DataFrame, base_date) -> Column:
    if isinstance(base_date, Column):
        return base_date
    if base_date is not None:
        return F.lit(base_date).cast("date")
    return F.col("base_date") if "base_date" in df.columns else F.current_date()


def flag_starts(lines: DataFrame, fmt: LogFormat, base_date=None, base_year: int | None = None) -> DataFrame:
    """Add ``is_start``: true on lines that begin an entry of ``fmt``."""
    steps = Steps(lines)
    return steps.finish(is_start=fmt.starts(steps.let, F.col("value"), _base(lines, base_date), base_year))


def read_lines(
    lines: DataFrame, fmt: LogFormat, base_date=None, base_year: int | None = None, text: str = "value"
) -> DataFrame:
    """Add ``fields``, the typed struct of each line, null where the line does not start an entry. No shuffle."""
    steps = Steps(lines)
    return steps.finish(fields=fmt.fields(steps.let, F.col(text), _base(lines, base_date), base_year))


def parse_lines(
    lines: DataFrame,
    fmt: LogFormat,
    base_date=None,
    base_year: int | None = None,
    keep: tuple[str, ...] = (),
    chunk_bits: int = CHUNK_BITS,
    max_part_bytes: int = MAX_PART_BYTES,
) -> DataFrame:
    """Parse lines into entries: start test, stitching, then typed fields of each entry's first line.

    Fields are read after stitching, so only the raw text is shuffled. An entry above ``max_part_bytes`` goes on in further
    ``part`` rows with the fields of its first line and the text as message; counts of entries take part 0. ``base_date`` (a date, a Column or a
    ``base_date`` column of ``lines``) completes time-only stamps; without any of them it is today.
    ``keep`` names columns of ``lines`` that are constant per source.
    """
    carried = tuple(dict.fromkeys(("source", *(c for c in ("base_date",) if c in lines.columns), *keep)))
    flagged = flag_starts(lines, fmt, base_date, base_year)
    entries = stitch(flagged, keep=carried, chunk_bits=chunk_bits, max_part_bytes=max_part_bytes)
    first = entries.withColumn(
        "first_text",
        F.when(F.col("headed"), F.coalesce("head", F.substring_index("raw", "\n", 1))),
    )
    parsed = read_lines(first, fmt, base_date, base_year, text="first_text")
    rest = F.substr("raw", F.length("first_text") + 1)
    text = {f: F.coalesce(F.col(f"fields.{f}"), F.lit("")) for f in ("level", "thread", "logger", "ip")}
    out = [
        F.col("fields.timestamp").alias("timestamp"),
        *[c.alias(f) for f, c in text.items()],
        F.lit(0).alias("port"),
        F.coalesce(F.when(F.col("part") == 0, F.concat("fields.message", rest)), F.col("raw")).alias("message"),
        "source",
        "raw",
    ]
    extra = [c for c in carried if c != "source"]
    return parsed.select(*out, "source_path", "block_start", "line_id", "part", *extra)
