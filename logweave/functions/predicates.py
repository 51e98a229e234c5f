"""Filters as boolean Columns; inactive ones are None and left out of the plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.fields import LEVELS, clock_text, level_rank, short_logger, short_thread
from logweave.functions.timepattern import quote
from logweave.session import settle, small_side

# Filter columns and the value each one compares.
FACETS = {
    "level": lambda: F.col("level"),
    "thread": lambda: short_thread("thread"),
    "logger": lambda: short_logger("logger"),
    "ip": lambda: F.col("ip"),
    "source": lambda: F.col("source"),
}

# Values as a user sees and searches them.
SHOWN = {
    "timestamp": lambda: clock_text("timestamp"),
    "level": lambda: F.col("level"),
    "thread": lambda: short_thread("thread"),
    "logger": lambda: short_logger("logger"),
    "ip": lambda: F.col("ip"),
    "message": lambda: F.col("message"),
    "source": lambda: F.col("source"),
}

# Selections above this size are joined instead of written into the plan.
IN_LIST_LIMIT = 1000


def selection(value: Column, chosen: Iterable[str] | None, domain: Iterable[str] | None = None) -> Column | None:
    """``value`` is one of ``chosen``. Inactive (None) if nothing or the whole ``domain`` is chosen."""
    chosen = set(chosen or ())
    if not chosen or (domain is not None and len(chosen) == len(set(domain))):
        return None
    return F.coalesce(value.isin(*sorted(chosen)), F.lit(False))


def semi_selection(df: DataFrame, value: Column, chosen: DataFrame) -> DataFrame:
    """Rows whose ``value`` is in the one-column DataFrame ``chosen``, for selections of any size.

    A small selection is broadcast. Beyond that both sides are shuffled; adaptive execution splits a hot value.
    """
    name = chosen.columns[0]
    values = settle(chosen.distinct())
    return df.join(small_side(values) or values, value == F.col(name), "left_semi")


def valid_regex(df: DataFrame, pattern: str) -> bool:
    """Whether Spark accepts ``pattern``; tried on one literal."""
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(pattern)).first()
    except Exception as e:
        if "regex" in str(e).lower() or "pattern" in str(e).lower():
            return False
        raise
    return True


def message_matches(pattern: str, ignore_case: bool = False) -> Column | None:
    """Regex found anywhere in the message; an empty pattern is inactive."""
    if not pattern:
        return None
    return F.coalesce(F.col("message").rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the active conditions; true if there is none."""
    active = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, active) if active else F.lit(True)


def row_filter(
    selections: Mapping[str, Iterable[str]] | None = None,
    message: str = "",
    domains: Mapping[str, Iterable[str]] | None = None,
    ignore_case: bool = False,
) -> dict[str, Column | None]:
    """The conditions of one filter bar, by facet name plus ``message``."""
    selections, domains = selections or {}, domains or {}
    unknown = set(selections) - set(FACETS)
    if unknown:
        raise ValueError(f"no such facet: {sorted(unknown)}")
    conditions = {f: selection(v(), selections.get(f), domains.get(f)) for f, v in FACETS.items()}
    conditions["message"] = message_matches(message, ignore_case)
    return conditions


def filter_entries(df: DataFrame, selections=None, message="", domains=None, ignore_case=False) -> DataFrame:
    """Rows that pass every active filter. An invalid message regex is ignored.

    Selections above :data:`IN_LIST_LIMIT` values become semi joins.
    """
    if message and not valid_regex(df, message):
        message = ""
    selections = {f: list(v or ()) for f, v in (selections or {}).items()}
    long = {f: v for f, v in selections.items() if len(v) > IN_LIST_LIMIT and len(set(v)) != len(set((domains or {}).get(f, ())))}
    short = {f: v for f, v in selections.items() if f not in long}
    active = [c for c in row_filter(short, message, domains, ignore_case).values() if c is not None]
    kept = df.filter(all_of(*active)) if active else df
    for facet, values in long.items():
        chosen = df.sparkSession.createDataFrame([(v,) for v in values], "_chosen string")
        kept = semi_selection(kept, FACETS[facet](), chosen)
    return kept


def text_match(query: str, columns: Iterable[str] = ("message",), whole_word: bool = False) -> Column:
    """Literal text in any of the named columns as shown, ignoring ASCII case, optionally as a whole word."""
    edge = r"\b" if whole_word else ""
    pattern = f"(?i){edge}{quote(query)}{edge}"
    hits = [F.coalesce(SHOWN[c]().rlike(pattern), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def at_least(level: Column, threshold: str = "INFO") -> Column:
    """Severity at or above ``threshold``."""
    return level_rank(level) >= LEVELS.index(threshold.upper())


def has_times(df: DataFrame, by: str = "view") -> DataFrame:
    """Per view, whether it has any timed entry."""
    return df.groupBy(by).agg(F.max(F.col("timestamp").isNotNull()).alias("timed"))
