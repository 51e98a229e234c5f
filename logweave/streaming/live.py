"""Live ingestion with Structured Streaming: framing, sticky routing, append and running facets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.functions.fields import view_title
from logweave.schema import DISCONNECT, REMOTE_APP
from logweave.streaming.events import XML_END

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("remote", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("xml", T.StringType()),
    ]
)


def use_rocksdb(spark) -> None:
    """State store that the stateful operators here need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Framing(StatefulProcessor):
    """Keeps the unfinished lines of one connection until an end tag arrives, or for the time to live."""

    def __init__(self, ttl_ms: int | None = None):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getListState("open", "line string", self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("seq", kind="stable")
        cuts = lines["line"].str.contains(XML_END, regex=False) | (lines["event_kind"] == DISCONNECT)
        if not cuts.any():
            self._open.appendList([(x,) for x in lines["line"]])
            return
        waiting = [r[0] for r in self._open.get()] if self._open.exists() else []
        frames = []
        for seq, line, kind in zip(lines["seq"], lines["line"], lines["event_kind"]):
            if kind == DISCONNECT:
                waiting = []
                continue
            waiting.append(line)
            if XML_END in line:
                frames.append((key[0], seq, "\n".join(waiting) + "\n"))
                waiting = []
        self._open.clear()
        if waiting:
            self._open.put([(x,) for x in waiting])
        if frames:
            yield pd.DataFrame(frames, columns=FRAME_SCHEMA.names)

    def close(self) -> None:
        pass


def frame_xml_stream(lines: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming twin of :func:`logweave.streaming.events.frame_xml`: (remote, seq, xml).

    ``lines`` has remote, seq, line and event_kind; a disconnect drops the unfinished lines. The order of a
    connection is that of ``seq``, within a micro-batch and from one to the next. Bound the micro-batch at
    the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``): the lines of one connection in one
    micro-batch are framed together. Unfinished lines of a connection that is silent for ``ttl_ms`` are dropped;
    such a query goes on checking by the clock and is never done with ``availableNow``.
    """
    return (
        lines.select("remote", "seq", "line", "event_kind")
        .groupBy("remote")
        .transformWithStateInPandas(_Framing(ttl_ms), FRAME_SCHEMA, "Append", "ProcessingTime" if ttl_ms else "None")
    )


class _Routing(StatefulProcessor):
    """Remembers the view of a connection from its first event until it disconnects, or for the time to live."""

    def __init__(self, ttl_ms: int | None = None):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._view = handle.getValueState("view", "app string, ip string, port int", self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        view = tuple(self._view.get()) if self._view.exists() else None
        out = []
        for row in events.itertuples(index=False):
            if row.event_kind == DISCONNECT:
                view = None
                continue
            if view is None:
                port = None if pd.isna(row.port) else int(row.port)
                view = (row.source, row.ip, port if row.source == REMOTE_APP else -1)
            out.append((key[0], row.seq, *view))
        if view is None:
            self._view.clear()
        else:
            self._view.update(view)
        yield pd.DataFrame(out, columns=ROUTE_SCHEMA.names)

    def close(self) -> None:
        pass


ROUTE_SCHEMA = T.StructType(
    [
        T.StructField("remote", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("app", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("view_port", T.IntegerType()),
    ]
)


def route_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming twin of :func:`logweave.streaming.sessions.route_batch`: (remote, seq, view) per event.

    Only the routing columns pass through the Python workers. A connection that is silent for ``ttl_ms`` is forgotten,
    its next event opens a view anew.
    """
    routed = (
        events.select("remote", "seq", "event_kind", "source", "ip", "port")
        .groupBy("remote")
        .transformWithStateInPandas(_Routing(ttl_ms), ROUTE_SCHEMA, "Append", "ProcessingTime" if ttl_ms else "None")
    )
    return routed.select("remote", "seq", view_title("app", "ip", "view_port").alias("view"))


def append_to(entries: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append a stream of entries to a Parquet folder in arrival order; returns the running query."""
    writer = entries.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
