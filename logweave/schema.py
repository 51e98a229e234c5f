"""Row shapes shared by every operator.

A *line* is one physical line of a source, an *entry* one logical log record.
Both carry ``(source_path, block_start, line_id)``, which orders the rows of a
source without a global sort: ``block_start`` orders the splits of a file and
``line_id`` orders the lines inside one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_KEY = ("source_path", "block_start", "line_id")

LINE_SCHEMA = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("line_id", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("thread", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

ENTRY_FIELDS = tuple(f.name for f in ENTRY_SCHEMA.fields)

# Source name given to live events that carry no application name.
REMOTE_APP = "RemoteApp"
# Event kind that ends a connection.
DISCONNECT = "disconnect"


def entry_key(block_start="block_start", line_id="line_id") -> Column:
    """Orderable position of an entry inside its source."""
    return F.struct(F.col(block_start).alias("block_start"), F.col(line_id).alias("line_id"))


def as_entries(df: DataFrame, *extra: str) -> DataFrame:
    """Bring ``df`` into the canonical column order and types; absent columns get their empty value."""
    empty = {"timestamp": None, "port": 0}
    present = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in present else F.lit(empty.get(f.name, ""))).cast(f.dataType).alias(f.name)
        for f in ENTRY_SCHEMA.fields
    ]
    return df.select(*cols, *extra)
