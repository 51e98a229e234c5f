"""Text search over views: counting and stepping through matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.profile import entry_once
from logweave.schema import LINE_KEY


def count_matches(entries: DataFrame, match: Column, by: str | None = "view") -> DataFrame:
    """Number of matching entries (not occurrences), per view or over all rows.

    An entry that goes on in further parts counts once, whichever of them match: entries whose first part does not match are
    counted by key. Later parts are rare, and stored entries without them are skipped by their statistics.
    """
    keys = [by] if by else []
    hits = entries.filter(match)
    counted = hits.filter(entry_once(entries)).groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    if "part" not in entries.columns:
        return counted
    first = hits.filter("part = 0").select(*LINE_KEY)
    later = hits.filter("part > 0").select(*keys, *LINE_KEY).distinct().join(first, list(LINE_KEY), "left_anti")
    later = later.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return counted.unionByName(later).groupBy(*keys).agg(F.sum("matches").alias("matches"))


def _first_part(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Instead of a later part of an entry, its first one."""
    if "part" not in entries.columns:
        return found
    key = found.select(*LINE_KEY)
    return entries.filter("part = 0").join(F.broadcast(key), list(LINE_KEY), "left_semi").select(*entries.columns)


def find_next(
    entries: DataFrame,
    match: Column,
    order: Sequence[str],
    cursor: Sequence | None = None,
    backward: bool = False,
) -> DataFrame:
    """The next match after the cursor (before it if ``backward``); no row if there is none.

    ``order`` names the columns that order the rows of the view, ``cursor`` holds their values. Without a
    cursor the search starts at the first (last) row. A minimum, not a sort. A match in a later part of an entry is one
    of the entry, which is given by its first part.
    """
    order, cursor = _without_part(order, cursor)
    position = F.struct(*order)
    hits = entries.filter(match)
    if cursor is not None:
        here = _cursor(entries, order, cursor)
        hits = hits.filter(position < here if backward else position > here)
    pick = F.max_by if backward else F.min_by
    found = hits.agg(pick(F.struct(*entries.columns), position).alias("row"))
    return _first_part(found.filter(F.col("row").isNotNull()).select("row.*"), entries)


def find_next_in_views(
    entries: DataFrame,
    match: Column,
    views: Sequence[str],
    order: Sequence[str],
    start_view: str,
    cursor: Sequence | None = None,
    backward: bool = False,
) -> DataFrame:
    """Like :func:`find_next`, going on through the other views in order and around the end.

    The start view is searched only past the cursor; the others from their first (last) row.
    """
    order, cursor = _without_part(order, cursor)
    begin = views.index(start_view) if start_view in views else 0
    n = len(views)
    step = {v: (begin - i if backward else i - begin) % n for i, v in enumerate(views)}
    turn = F.create_map(*[F.lit(x) for kv in step.items() for x in kv])[F.col("view")]
    position = F.struct(*order)
    hits = entries.filter(match & F.col("view").isin(*views)).withColumn("_turn", turn)
    if cursor is not None:
        here = _cursor(entries, order, cursor)
        hits = hits.filter((F.col("_turn") > 0) | (position < here if backward else position > here))
    rank = F.struct((-F.col("_turn")).alias("t"), position.alias("p")) if backward else F.struct("_turn", position.alias("p"))
    pick = F.max_by if backward else F.min_by
    found = hits.agg(pick(F.struct(*entries.columns), rank).alias("row"))
    return _first_part(found.filter(F.col("row").isNotNull()).select("row.*"), entries)


def _without_part(order: Sequence[str], cursor: Sequence | None) -> tuple[list[str], list | None]:
    """Order and cursor of entries, whatever part of one the cursor stands on."""
    places = [k for k, c in enumerate(order) if c != "part"]
    return [order[k] for k in places], None if cursor is None else [cursor[k] for k in places]


def _cursor(entries: DataFrame, order: Sequence[str], cursor: Sequence) -> Column:
    types = {f.name: f.dataType for f in entries.schema.fields}
    return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, cursor)])
