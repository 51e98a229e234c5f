"""Sticky routing of live events: the first event of a connection decides the view of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.fields import view_title
from logweave.operators.ordered import carry_forward
from logweave.operators.stitch import CHUNK_BITS
from logweave.operators.timeline import view_port
from logweave.schema import DISCONNECT
from logweave.session import attach, settle

def view_key(app="source", ip="ip", port="port") -> Column:
    """Identity of the view an event opens: app and ip, and port for unnamed apps."""
    return F.struct(F.col(app).alias("app"), F.col(ip).alias("ip"), view_port(app, port).alias("port"))


def route_batch(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Add ``view``, the title of the view each event goes to; disconnects end a session and are dropped.

    ``events`` has remote, seq, event_kind, source, ip and port. Long connections are cut into chunks; the
    session table, one row per session, is joined by broadcast or salted.
    """
    ended = F.when(F.col("event_kind") == DISCONNECT, F.col("seq"))
    chunk = F.shiftright(F.col("seq"), chunk_bits)
    marked = carry_forward(events, ["remote"], chunk, ["seq"], ended, "session")
    live = marked.filter(F.col("event_kind") != DISCONNECT).withColumn("session", F.coalesce("session", F.lit(-1)))
    opened = settle(live.groupBy("remote", "session").agg(F.min_by(view_key(), "seq").alias("key")))
    routed = attach(live, opened, ["remote", "session"], "left")
    return routed.withColumn("view", view_title(F.col("key.app"), F.col("key.ip"), F.col("key.port"))).drop("key", "session")


def route_with_idle(events: DataFrame, idle_seconds: int, time_col: str = "ts") -> DataFrame:
    """Like :func:`route_batch`, in the order of (time, seq), and a silence of more than ``idle_seconds`` ends a session too.

    An event before a silence lies in the same stretch of ``idle_seconds`` or in the one before, so only neighbouring stretches
    of a connection are compared, never a connection as a whole. Events without a time are left out.
    """
    events = events.filter(F.col(time_col).isNotNull())
    micros = F.unix_micros(F.col(time_col))
    idle = idle_seconds * 1_000_000
    placed = events.withColumns({"_at": micros, "_stretch": F.floor(micros / F.lit(idle))})
    last = placed.groupBy("remote", "_stretch").agg(F.max("_at").alias("_last"))
    last = last.select("remote", (F.col("_stretch") + 1).alias("_stretch"), "_last")
    inside = Window.partitionBy("remote", "_stretch").orderBy("_at", "seq")
    placed = placed.withColumn("_before", F.lag("_at").over(inside)).join(last, ["remote", "_stretch"], "left")
    gap = F.col("_at") - F.coalesce("_before", "_last")
    position = F.struct(F.col("_at").alias("at"), F.col("seq").alias("seq"))
    new = gap.isNull() | (gap > idle) | (F.col("event_kind") == DISCONNECT)
    marked = carry_forward(placed, ["remote"], F.col("_stretch"), ["_at", "seq"], F.when(new, position), "session")
    live = marked.filter(F.col("event_kind") != DISCONNECT)
    opened = settle(live.groupBy("remote", "session").agg(F.min_by(view_key(), position).alias("key")))
    routed = attach(live, opened, ["remote", "session"], "left")
    routed = routed.withColumn("view", view_title(F.col("key.app"), F.col("key.ip"), F.col("key.port")))
    return routed.drop("key", "session", "_at", "_stretch", "_before", "_last")
