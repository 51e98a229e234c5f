"""Time patterns (``yyyy-MM-dd HH:mm:ss.SSS`` and the like) as Spark expressions.

A pattern becomes one regular expression plus one replacement that rewrites a
matching text into ISO form; the ISO text is cast to ``timestamp_ntz``. The
result depends neither on the session time zone nor on the ANSI setting, zone
texts are accepted and dropped, and both strings may come from columns, so one
expression serves many formats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.steps import Steps

# English names as they appear in log time stamps.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# Marks a rewritten text; surrounding control characters are trimmed off before, so no raw text starts with it.
MARK = "\x02"
# Stands for the base date in the ISO text of a pattern without a full date.
BASE = "@"

_NUMBER = {1: r"(\d{1,2})", 2: r"(\d{2})"}


@dataclass(frozen=True)
class TimeFormat:
    """Compiled pattern: ``regex`` accepts a whole text, ``rewrite`` turns it into ISO form."""

    pattern: str
    regex: str
    rewrite: str
    dated: bool
    timed: bool


def quote(text: str) -> str:
    """Escape a literal for a Java regular expression."""
    return "".join(c if c.isalnum() or ord(c) > 127 or c == " " else "\\" + c for c in text)


def _tokens(pattern: str):
    for run in re.finditer(r"'((?:[^']|'')*)'|(([A-Za-z])\3*)|([^A-Za-z'])", pattern, re.S):
        if run.group(2):
            yield "field", run.group(2)
        elif run.group(4):
            yield "text", run.group(4)
        else:
            yield "text", run.group(1).replace("''", "'") or "'"


@lru_cache(maxsize=None)
def compile_time(pattern: str, base_year: int | None = None) -> TimeFormat:
    """Compile a time pattern.

    Without year, month and day together only the time of day counts and the base date is added. With
    ``base_year`` a pattern that has month and day but no year keeps them.
    """
    regex, groups, seen = [], 0, {}

    def capture(part: str, field: str) -> None:
        nonlocal groups
        groups += 1
        seen[field] = groups
        regex.append(part)

    for kind, text in _tokens(pattern):
        n = len(text)
        if kind == "text":
            regex.append(quote(text))
        elif text[0] in "yu" and n in (2, 4):
            capture(rf"(\d{{{n}}})", "y2" if n == 2 else "y")
        elif text == "MMM":
            capture("(" + "|".join(re.findall("...", MONTHS)) + ")", "M")
        elif text[0] in "MdHms" and n in _NUMBER:
            capture(_NUMBER[n], text[0])
        elif text[0] == "S" and n <= 9:
            # microseconds are kept, finer digits dropped
            capture(rf"(\d{{{min(n, 6)}}})\d{{{max(n - 6, 0)}}}", "S")
        elif text[0] == "E" and n <= 3:
            capture("(" + "|".join(WEEKDAYS) + ")", "E")
        elif text[0] == "z":
            regex.append(r"[A-Za-z][A-Za-z0-9_/+:\-]*")
        elif text[0] == "Z" and n <= 3:
            regex.append(r"[+\-]\d{4}")
        elif text[0] == "X" and n <= 3:
            regex.append(r"(?:Z|[+\-]\d{2}(?::?\d{2})?)")
        else:
            raise ValueError(f"unsupported field {text!r} in time pattern {pattern!r}")

    year = f"${seen['y']}" if "y" in seen else f"20${seen['y2']}" if "y2" in seen else None
    month_day = f"${seen['M']}-${seen['d']}" if "M" in seen and "d" in seen else None
    if year is None and month_day and base_year is not None:
        year = f"{base_year:04d}"
    dated = bool(year and month_day)
    clock = ":".join(f"${seen[f]}" if f in seen else "00" for f in "Hms")
    fraction = f".${seen['S']}" if "S" in seen else ""
    weekday = f"|${seen['E']}" if "E" in seen and dated else ""
    date = f"{year}-{month_day}" if dated else BASE
    return TimeFormat(
        pattern=pattern,
        regex=r"\A" + "".join(regex) + r"\z",
        rewrite=f"{MARK}{date} {clock}{fraction}{weekday}",
        dated=dated,
        timed="H" in seen,
    )


def iso_text(let, text: Column, regex: Column, rewrite: Column) -> Column:
    """ISO form of ``text``; null where the pattern does not match. ``(?!)`` as regex never matches."""
    canon = let(F.regexp_replace(text, regex, rewrite))
    return F.when(canon.startswith(MARK), F.substr(canon, F.lit(2)))


def iso_to_timestamp(let, iso: Column, base_date: Column) -> Column:
    """``timestamp_ntz`` of an ISO text from :func:`iso_text`; null if there is no such time.

    ``let`` binds an intermediate result to a column (see :class:`logweave.functions.steps.Steps`).
    """
    iso = let(iso)
    weekday = F.when(F.contains(iso, F.lit("|")), F.substring_index(iso, "|", -1))
    body = F.substring_index(iso, "|", 1)
    name_at = F.instr(F.lit(MONTHS), F.substring(iso, 6, 3))
    body = let(
        F.when(
            iso.startswith(BASE), F.concat(base_date.cast("date").cast("string"), F.substr(body, F.lit(2)))
        )
        .when(
            (F.substring(iso, 6, 1) >= "A") & (name_at > 0),
            F.concat(
                F.substring(iso, 1, 5),
                F.lpad(((name_at + 2) / 3).cast("int").cast("string"), 2, "0"),
                F.substr(body, F.lit(9)),
            ),
        )
        .otherwise(body)
    )
    date, clock = F.substring_index(body, " ", 1), F.substring_index(body, " ", -1)
    # The last day of the month stands in for day 29 to 31 of a shorter month, as in 2023-02-31.
    month_end = F.last_day(F.concat(F.substring_index(date, "-", 2), F.lit("-01")).try_cast("date"))
    clamped = F.when(
        F.substring_index(date, "-", -1).isin("29", "30", "31"),
        F.concat(month_end.cast("string"), F.lit(" "), clock).try_cast("timestamp_ntz"),
    )
    # 24:00 is the start of the next day.
    midnight = F.when(
        clock.rlike(r"\A24:00:00(?:\.0*)?\z"), F.date_add(date.try_cast("date"), 1).cast("timestamp_ntz")
    )
    ts = let(F.coalesce(body.try_cast("timestamp_ntz"), clamped, midnight))
    return F.when(weekday.isNull() | (F.dayname(ts.cast("date")) == weekday), ts)


def with_time(
    df: DataFrame,
    text: str,
    out: str,
    pattern: str,
    base_date: Column | None = None,
    base_year: int | None = None,
) -> DataFrame:
    """Add ``out``: column ``text`` as ``timestamp_ntz`` under one fixed pattern, null where it does not fit."""
    compiled = compile_time(pattern, base_year)
    if not compiled.timed:
        return df.withColumn(out, F.lit(None).cast("timestamp_ntz"))
    steps = Steps(df)
    base = base_date if base_date is not None else F.current_date()
    iso = iso_text(steps.let, F.col(text), F.lit(compiled.regex), F.lit(compiled.rewrite))
    return steps.finish(**{out: iso_to_timestamp(steps.let, iso, base)})
