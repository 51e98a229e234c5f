"""What several operators share: stored tables, joins that bear hot keys, word patterns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import scratch_path

# A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: lineage ends at a durable table.

    ``group_bytes`` bounds its row groups, which writers and readers hold whole, for tables whose rows are long.
    """
    path = scratch_path(df.sparkSession, name)
    # Long rows are few: their size is looked at after some of them, not after the usual hundred.
    small = {"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "4"} if group_bytes else {}
    df.write.options(**small).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, share: int = 1000, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``table``, which has one row per key and in ``weight`` the key's number of rows.

    Keys holding more than 1/``share`` of all rows are fewer than ``share`` by counting, so they may be broadcast
    at any input size; no task then gathers their rows. All other keys meet in an ordinary shuffle join. Both
    inputs are read twice: pass stored tables. Keys must not be null; a left join keeps rows of keys that the table lacks.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share > F.lit(total)
    hot_table = F.broadcast(table.filter(hot))
    met = rows.join(hot_table, keys)
    rest = rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(table.filter(~hot), keys, how).select(*met.columns))


def fresh(name: str, taken: list[str]) -> str:
    """A column name starting with ``name`` that is not in ``taken`` (names compare without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def whole_text(column: str | Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_remainder(id_col: str | Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; 0 for a null id, which is therefore never learned from."""
    key = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.coalesce(F.crc32(key.cast("binary")) % modulus, F.lit(0))


@contextmanager
def handed_in_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand at most ``rows`` rows at once to a Python worker, which bounds its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, as a URI."""
    path = scratch_path(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
