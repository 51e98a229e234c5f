"""Live events in the order of their times, across micro-batches: a reorder buffer per connection (or bucket of them) and sessions that end in silence.

The events of a connection wait in state until the watermark has passed them; then they are taken in the order of (time, seq).
So an event that comes late by less than the watermark's delay is in its place, and the result is that of the batch twin.
Later ones are dropped by the watermark; the query's progress counts them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.functions.fields import view_title
from logweave.operators.ordered import wall_seconds
from logweave.schema import DISCONNECT, REMOTE_APP
from logweave.streaming.events import XML_END
from logweave.streaming.live import FRAME_SCHEMA, ROUTE_SCHEMA


def instant(timestamp: str | Column) -> Column:
    """A wall-clock time as an instant, whatever the session's time zone."""
    ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.timestamp_micros(wall_seconds(ts) * 1_000_000 + F.date_format(ts, "SSSSSS").cast("long"))


def _micros(timestamp: str) -> Column:
    return F.unix_micros(F.col(timestamp))


class _Ordered(StatefulProcessor):
    """Buffers the rows of a connection or of a bucket of connections and hands them on in order once the watermark has passed them.

    They wait as Arrow batches, one per call, and its open sessions are one value, so calls to the state grow with the
    groups and not with their rows. ``waiting`` names the columns of a row: connection, time in microseconds, seq, others;
    ``opened`` the state that holds what is open of each connection.
    """

    waiting = ""
    opened = ""

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1_000_000
        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        self.shape = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in self.waiting.split(", "))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("waiting", "rows binary")
        self.sessions = handle.getValueState(self.opened, "sessions string")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for batch in rows:
            # Whole numbers with nulls come as floating point; the shape makes them whole again.
            table = pa.Table.from_pandas(batch[self.shape.names], self.shape, preserve_index=False)
            self.buffer.appendValue((_packed(table),))
            earliest.append(int(batch["at"].min()))
        if earliest:
            self._wake(-(-min(earliest) // 1000))
        return iter(())

    def _wake(self, ms: int) -> None:
        """A timer for the group, unless an earlier one is set."""
        due = self.due.get()
        if due is None or ms < due[0]:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()
        if due is None or due[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier timer has taken its place
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [_unpacked(r[0]) for r in self.buffer.get()] if self.buffer.exists() else []
        rows = pa.concat_tables(held) if held else self.shape.empty_table()
        ready = rows.filter(pc.field("at") <= passed)
        later = rows.filter(pc.field("at") > passed)
        value = self.sessions.get()
        # Per connection the time of its last row and what is open of it.
        sessions = {remote: (last, state) for remote, last, state in json.loads(value[0])} if value else {}
        if len(ready):
            if len(later):
                self.buffer.put([(_packed(later),)])
            else:
                self.buffer.clear()
            ready = ready.take(pc.sort_indices(ready, [(c, "ascending") for c in self.shape.names[:3]]))
            made = self.take(ready.columns, sessions)
            if len(made):
                yield made
        # The next event of a connection that is left out here comes after the silence that ends the session.
        kept = [(remote, last, state) for remote, (last, state) in sessions.items() if state and last + self.idle >= passed]
        if kept:
            self.sessions.update((json.dumps(kept),))
        elif value:
            self.sessions.clear()
        wake = [(last + self.idle) // 1000 + 1 for _, last, _ in kept]
        if len(later):
            wake.append(-(-pc.min(later["at"]).as_py() // 1000))
        if wake:
            self._wake(min(wake))

    def take(self, columns: list[pa.ChunkedArray], sessions: dict) -> pd.DataFrame:
        """What the rows give, which are in order of connection, time and seq; ``sessions`` is brought up to date."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _OrderedRouting(_Ordered):
    waiting = "remote string, at long, seq long, event_kind string, source string, ip string, port int"
    opened = "view"

    def take(self, columns, sessions):
        out = []
        for remote, at, seq, kind, source, ip, port in zip(*(c.to_pylist() for c in columns)):
            last, view = sessions.get(remote, (at, None))
            if at - last > self.idle or kind == DISCONNECT:
                view = None
            if kind != DISCONNECT:
                view = view or (source, ip, port if source == REMOTE_APP else -1)
                out.append((remote, seq, *view))
            sessions[remote] = (at, view)
        return pd.DataFrame(out, columns=ROUTE_SCHEMA.names)


class _OrderedFraming(_Ordered):
    waiting = "remote string, at long, seq long, event_kind string, line string"
    opened = "open"

    def take(self, columns, sessions):
        frames = []
        for remote, at, seq, kind, line in zip(*(c.to_pylist() for c in columns)):
            last, lines = sessions.get(remote, (at, []))
            if kind == DISCONNECT or at - last > self.idle:
                lines = []
            if kind != DISCONNECT:
                lines.append(line)
                if XML_END in line:
                    frames.append((remote, seq, "\n".join(lines) + "\n"))
                    lines = []
            sessions[remote] = (at, lines)
        return pd.DataFrame(frames, columns=FRAME_SCHEMA.names)


def _run(rows: DataFrame, processor: _Ordered, time_col: str, delay_seconds: int, shape, buckets: int | None) -> DataFrame:
    marked = rows.filter(F.col(time_col).isNotNull()).withWatermark(time_col, f"{delay_seconds} seconds").withColumn("at", _micros(time_col))
    marked = marked.select(time_col, *processor.shape.names)
    key = "remote"
    if buckets:
        key = "bucket"
        marked = marked.withColumn(key, F.pmod(F.xxhash64("remote"), F.lit(buckets)).cast("int"))
    return marked.groupBy(key).transformWithStateInPandas(processor, shape, "Append", "EventTime")


def route_in_order(events: DataFrame, idle_seconds: int, delay_seconds: int, time_col: str = "ts", buckets: int | None = None) -> DataFrame:
    """Streaming twin of :func:`logweave.streaming.sessions.route_with_idle`: (remote, seq, view) per event.

    ``time_col`` is a timestamp; rows without one are left out. Events may come in any order within ``delay_seconds``. State holds the events of the delay and the
    view of each connection for ``idle_seconds``, by connection or, for very many of them, by that many ``buckets`` of connections,
    each a group of a micro-batch; it needs the RocksDB store (``live.use_rocksdb``).
    """
    routed = _run(events, _OrderedRouting(idle_seconds), time_col, delay_seconds, ROUTE_SCHEMA, buckets)
    return routed.select("remote", "seq", view_title("app", "ip", "view_port").alias("view"))


def frame_in_order(lines: DataFrame, idle_seconds: int, delay_seconds: int, time_col: str = "ts", buckets: int | None = None) -> DataFrame:
    """XML frames (remote, seq, xml) of lines that may come in any order within ``delay_seconds``.

    ``lines`` has remote, seq, line, event_kind and ``time_col``; lines of one time stand in the order of ``seq``. A disconnect or a
    silence of more than ``idle_seconds`` drops the unfinished lines. ``buckets`` as for :func:`route_in_order`.
    """
    return _run(lines, _OrderedFraming(idle_seconds), time_col, delay_seconds, FRAME_SCHEMA, buckets)
