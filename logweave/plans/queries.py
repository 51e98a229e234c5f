"""One query per operator over the driver tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the statement that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Events as the parts of a log entry, as in logweave.plans.rendering.events.
EVENTS = """
ev AS (
  SELECT event_id, ts, user_id, event_type, event_type AS view,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS lvl,
         'user-' || user_id AS thr,
         'app.web.' || event_type AS log,
         event_id || ' ' || props AS msg,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp,
         date_trunc('milliseconds', ts) AS ts_ms,
         event_type || '-' || strftime(ts, '%Y-%m-%d') || '.log' AS source,
         '10.0.0.' || (user_id % 4) AS ip
  FROM events
)"""

# The events as lines in the default layout.
LINES = (
    EVENTS
    + """,
ln AS (SELECT *, stamp || ' [' || thr || '] ' || lvl || ' ' || log || ' - ' || msg AS line FROM ev)"""
)
