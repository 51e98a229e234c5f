"""Log formats as data: layouts, regex configurations, mixtures and the built-in registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.fields import BLANK_CHARS
from logweave.functions.timepattern import compile_time, iso_text, iso_to_timestamp, quote

Let = Callable[[Column], Column]

# Order of the captured fields in every rule.
FIELDS = ("timestamp", "level", "thread", "logger", "ip", "message")
# Separates captured fields in the rewritten line.
SEP = "\x01"
NEVER = "(?!)"
FALLBACK = -1

FIELDS_TYPE = (
    "struct<timestamp:timestamp_ntz,level:string,thread:string,logger:string,ip:string,message:string>"
)


@dataclass(frozen=True)
class Rule:
    """One way to read a line: ``regex`` spans the whole line, ``groups`` gives the group number per field.

    Group -1 is an absent field, group 0 the whole line. Without ``time`` the rule yields untimed entries.
    """

    regex: str
    groups: tuple[int, ...]
    time: str | None
    trim: bool

    @property
    def rewrite(self) -> str:
        return SEP.join(f"${g}" if g >= 0 else "" for g in self.groups)

    def time_pair(self, base_year: int | None) -> tuple[str, str]:
        """(regex, rewrite) of the time stamp; the regex is empty for an untimed rule."""
        if self.time is None:
            return "", ""
        compiled = compile_time(self.time, base_year)
        return (compiled.regex if compiled.timed else NEVER), compiled.rewrite


def _java_groups(regex: str) -> int:
    """Number of capturing groups, ignoring escaped and class characters."""
    plain = re.sub(r"\\Q.*?\\E|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", regex, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<[A-Za-z]", plain))


class LogFormat:
    """A format: a first-line test, a start test and the typed fields of a starting line.

    ``let`` binds an intermediate Column (see :class:`logweave.functions.steps.Steps`). Use
    :class:`ColumnFormat` to plug in a format of your own.
    """

    name: str

    def first_line(self, line: Column) -> Column:
        raise NotImplementedError

    def starts(self, let: Let, line: Column, base_date: Column, base_year: int | None = None) -> Column:
        """True where the line starts an entry."""
        raise NotImplementedError

    def fields(self, let: Let, line: Column, base_date: Column, base_year: int | None = None) -> Column:
        """Struct of :data:`FIELDS`; null where the line does not start an entry."""
        raise NotImplementedError


class RuleFormat(LogFormat):
    """A format that is an ordered list of rules; the first rule that fits reads the line."""

    rules: tuple[Rule, ...]

    def first_line(self, line):
        test = F.lit(False)
        for rule in self.rules:
            test = test | line.rlike(rule.regex)
        return F.coalesce(test, F.lit(False))

    def starts(self, let, line, base_date, base_year=None):
        test = F.lit(False)
        for rule in self.rules:
            test = test | _start(let, line, _literals(rule, base_year), base_date)
        return test

    def fields(self, let, line, base_date, base_year=None):
        reads = [_read(let, line, _literals(r, base_year), base_date) for r in self.rules]
        return F.coalesce(*reads, F.lit(None).cast(FIELDS_TYPE))


class Layout(RuleFormat):
    """Format given by a layout string such as ``%d{HH:mm:ss.SSS} [%t] %-5level %logger{36} - %msg%n``."""

    def __init__(self, layout: str, name: str | None = None):
        self.layout = layout
        self.name = name or layout
        self.rules = (compile_layout(layout),)

    def __repr__(self):
        return f"Layout({self.layout!r})"


class RegexFormat(RuleFormat):
    """Format given by a first-line regex, an entry regex (found anywhere), a time pattern and group numbers.

    Group number -1 means that the field is absent and stays empty.
    """

    def __init__(self, name, first_line, entry, time, *, timestamp=1, level=-1, thread=-1, logger=-1, ip=-1, message=-1):
        self.name = name
        self.first_line_regex = rf"\A(?:{first_line})\z"
        groups = (timestamp, level, thread, logger, ip, message)
        if max(groups) > _java_groups(entry):
            raise ValueError(f"format {name!r} uses group {max(groups)}, the regex has {_java_groups(entry)}")
        whole = rf"\A(?s:.*?)(?:{entry})(?s:.*)\z"
        self.rules = (Rule(whole, groups, time, trim=False),)

    def first_line(self, line):
        return F.coalesce(line.rlike(self.first_line_regex), F.lit(False))


class Mixed(RuleFormat):
    """Several layouts in one file: each line is read by the first layout that fits it."""

    def __init__(self, name: str, layouts: Sequence[str]):
        self.name = name
        self.rules = tuple(compile_layout(x) for x in layouts)


class ColumnFormat(LogFormat):
    """Extension point: a format made of Column functions (built-in expressions or a pandas UDF)."""

    def __init__(self, name: str, first_line: Callable[[Column], Column], fields: Callable[[Column], Column]):
        self.name = name
        self._first_line = first_line
        self._fields = fields

    def first_line(self, line):
        return F.coalesce(self._first_line(line), F.lit(False))

    def starts(self, let, line, base_date, base_year=None):
        return self._fields(line).isNotNull()

    def fields(self, let, line, base_date, base_year=None):
        return self._fields(line).cast(FIELDS_TYPE)


_LAYOUT_TOKEN = re.compile(
    r"%d\{(?P<time>[^}]*)\}"
    r"|%(?P<host>h)(?![a-z])"
    r"|%(?P<thread>thread|t)(?![a-z])"
    r"|%[-0-9]*(?P<level>level)"
    r"|%[-0-9]*(?P<logger>logger)(?:\{[^}]*\})?"
    r"|%(?P<message>msg)"
    r"|%(?P<skip>config|n)"
    r"|%(?P<bad>[-0-9A-Za-z]+)"
    r"|%?(?P<blank> )"
    r"|%?(?P<text>.)",
    re.S,
)


def compile_layout(layout: str) -> Rule:
    """Turn a layout string into a rule."""
    regex, where, time = [], {}, None
    captures = {"time": "(.*?)", "host": "(.*?)", "thread": "(.*?)", "level": r"(\w+)", "logger": "(.*?)", "message": "(.*)"}
    target = {"time": "timestamp", "host": "ip"}
    for token in _LAYOUT_TOKEN.finditer(layout):
        kind = token.lastgroup
        if kind == "bad":
            raise ValueError(f"unknown layout field {token.group()!r} in {layout!r}")
        if kind in captures:
            regex.append(captures[kind])
            where[target.get(kind, kind)] = sum(p.startswith("(") for p in regex)
            if kind == "time":
                time = token.group("time")
        elif kind == "blank":
            if not regex or regex[-1] != r"\s+":
                regex.append(r"\s+")
        elif kind == "text":
            if not (token.group() == "%" and token.end() == len(layout)):
                regex.append(quote(token.group("text")))
    groups = tuple(where.get(f, 0 if f == "message" else -1) for f in FIELDS)
    return Rule(r"\A" + "".join(regex) + r"\z", groups, time, trim=True)


def _literals(rule: Rule, base_year: int | None) -> dict[str, Column]:
    time_regex, time_rewrite = rule.time_pair(base_year)
    return {
        "regex": F.lit(rule.regex),
        "rewrite": F.lit(rule.rewrite),
        "time_regex": F.lit(time_regex),
        "time_rewrite": F.lit(time_rewrite),
        "trim": F.lit(rule.trim),
        **{f: F.lit(g) for f, g in zip(FIELDS, rule.groups)},
    }


def _trimmed(text: Column, trim: Column) -> Column:
    return F.when(trim, F.btrim(text, F.lit(BLANK_CHARS))).otherwise(text)


def _group(line: Column, p: dict[str, Column], field: str) -> Column:
    extract = F.call_function("regexp_extract", line, p["regex"], F.greatest(p[field], F.lit(0)))
    return F.when(p[field] >= 0, extract).otherwise("")


def _start(let: Let, line: Column, p: dict[str, Column], base_date: Column) -> Column:
    """True where the line starts an entry; one pass of the line regex."""
    text = let(_trimmed(_group(line, p, "timestamp"), p["trim"]))
    timed = iso_to_timestamp(let, iso_text(let, text, p["time_regex"], p["time_rewrite"]), base_date).isNotNull()
    untimed = F.call_function("regexp_instr", line, p["regex"]) > 0
    return F.coalesce(F.when(p["time_regex"] == "", untimed).otherwise(timed), F.lit(False))


def _read(let: Let, line: Column, p: dict[str, Column], base_date: Column) -> Column:
    """Struct of the fields, null where the rule does not fit.

    All groups come out of one regex pass: the line is rewritten to its fields joined by :data:`SEP` and
    split again. A line that holds the separator itself is read group by group.
    """
    quick = F.split(F.regexp_replace(line, p["regex"], p["rewrite"]), SEP)
    careful = F.when(
        F.call_function("regexp_instr", line, p["regex"]) > 0, F.array(*[_group(line, p, f) for f in FIELDS])
    )
    parts = let(F.when(F.contains(line, F.lit(SEP)), careful).otherwise(quick))
    matched = F.size(parts) == len(FIELDS)
    text = [_trimmed(F.get(parts, F.lit(i)), p["trim"]) for i in range(5)]
    iso = iso_text(let, F.when(matched, text[0]), p["time_regex"], p["time_rewrite"])
    ts = let(iso_to_timestamp(let, iso, base_date))
    read = F.struct(
        ts.alias("timestamp"),
        *[t.alias(n) for t, n in zip(text[1:], FIELDS[1:5])],
        F.get(parts, F.lit(5)).alias("message"),
    )
    return F.when(matched & ((p["time_regex"] == "") | ts.isNotNull()), read)


class FormatSet(LogFormat):
    """Formats looked up per row by an index column; :data:`FALLBACK` makes every line its own entry.

    The rules are an array of literals indexed once per row and rank, so the expression has the size of one format
    however many formats there are. Spark keeps the compiled regex while the pattern stays the same from
    row to row, which it does within a source.

    ``used`` names the indexes that come at all, where they are known: the expression is then only as long as they ask.
    The JVM does not compile a method of more than 8000 bytes, and lines are then read several times slower.
    """

    name = "by index"

    def __init__(self, formats: Sequence[LogFormat], index: Column, used: Sequence[int] | None = None):
        self.formats = list(formats)
        self.index = index
        come = [(i, f) for i, f in enumerate(self.formats) if used is None or i in used]
        ruled = [(i, f) for i, f in come if isinstance(f, RuleFormat)]
        self.depth = max([len(f.rules) for _, f in ruled] or [0])
        self.custom = [(i, f) for i, f in come if not isinstance(f, RuleFormat)]
        # A single format needs no look-up: its rules are literals.
        self.place = F.lit(ruled[0][0] + 1) if len(come) == len(ruled) == 1 else F.greatest(index, F.lit(0)) + 1

    def _ranks(self, let: Let, base_year: int | None):
        """Per rank: the looked-up rule parts and whether the row's format has a rule of that rank."""
        for rank in range(self.depth):
            rules = [
                f.rules[rank] if isinstance(f, RuleFormat) and rank < len(f.rules) else None for f in self.formats
            ]
            rows = [r or Rule(NEVER, (-1,) * len(FIELDS), None, False) for r in rules]
            table = [F.struct(*[c.alias(n) for n, c in _literals(r, base_year).items()], F.lit(x is not None).alias("has")) for r, x in zip(rows, rules)]
            rule = let(F.element_at(F.array(*table), self.place))
            parts = {n: rule[n] for n in _literals(rows[0], base_year)}
            yield parts, rule["has"] & (self.index != FALLBACK)

    def first_line(self, line):
        test = F.lit(False)
        for i, f in enumerate(self.formats):
            test = F.when(self.index == i, f.first_line(line)).otherwise(test)
        return F.when(self.index == FALLBACK, F.lit(True)).otherwise(test)

    def starts(self, let, line, base_date, base_year=None):
        test = F.lit(False)
        for p, has_rule in self._ranks(let, base_year):
            # a row without a rule of this rank gets a null line and skips the regex
            test = test | _start(let, F.when(has_rule, line), p, base_date)
        for i, f in self.custom:
            test = F.when(self.index == i, f.starts(let, line, base_date, base_year)).otherwise(test)
        return F.when(self.index == FALLBACK, F.lit(True)).otherwise(test)

    def fields(self, let, line, base_date, base_year=None):
        none = F.lit(None).cast(FIELDS_TYPE)
        reads = [_read(let, F.when(has_rule, line), p, base_date) for p, has_rule in self._ranks(let, base_year)]
        out = F.coalesce(*reads, none)
        for i, f in self.custom:
            out = F.when(self.index == i, f.fields(let, line, base_date, base_year)).otherwise(out)
        return F.when(self.index == FALLBACK, none).otherwise(out)


def default_formats() -> list[LogFormat]:
    """The built-in formats in priority order; append your own to register them."""
    # The layouts, regexes and time patterns of the known log formats.
    return [
        Layout("%d{yyyy-MM-dd HH:mm:ss,SSS} %level [%logger] (%t) %msg%n"),
        Layout("%d{yyyy-MM-dd HH:mm:ss.SSS} [%t] %-5level %logger{36} - %msg%n"),
        Layout("%d{yyyy-MM-dd HH:mm:ss,SSS} [%t] (%logger) - %msg%n"),
        Layout("%level %d{yyyy-MM-dd HH:mm:ss,SSS} [%t] (%logger) - %msg%n"),
        Layout("%d{yyyy-MM-dd HH:mm:ss} : %msg%n"),
        Layout("%d{yyyy-MM-dd HH:mm:ss,SSS} %level - %msg%n"),
        Layout("[%d{MMdd/HHmmss.SSS}:%level:%logger] %msg%n"),
        Layout("%d{dd-MMM-yyyy HH:mm:ss.SSS} %level [%t] %logger %msg%n"),
        Layout("%d{EEE, dd MMM yyyy HH:mm:ss z} %level %logger > %msg%n"),
        Layout("%level %d{yyyy-MM-dd HH:mm:ss.SSS} [%t] %logger: %msg%n"),
        Layout("%d{HH:mm:ss.SSS} [%t] %level  %logger - %msg%n"),
        Layout("%d{yyyy-MM-dd HH:mm:ss,SSS} %level %t [%logger] %msg%n"),
        RegexFormat(
            "logback internal",
            r"^\d{2}:\d{2}:\d{2},\d{3}\s+\|-\w+\s+in\s+.*",
            r"^(\d{2}:\d{2}:\d{2},\d{3})\s+\|-(\w+)\s+in\s+(.*?)\s+-\s+(.*)$",
            "HH:mm:ss,SSS",
            level=2, logger=3, message=4,
        ),
        RegexFormat(
            "condensed",
            r"^\d{2}:\d{2}:\d{2}\.\d{3}\s+\w+\s+.*",
            r"^(\d{2}:\d{2}:\d{2}\.\d{3})\s+(\w+)\s+(.*?)\s+-\s+(.*)$",
            "HH:mm:ss.SSS",
            level=2, logger=3, message=4,
        ),
        RegexFormat(
            "tab-separated proxy",
            r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\t.*",
            r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\t(\w+)\t(.*?)(?:\t([a-zA-Z0-9_.-]+))?$",
            "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
            level=2, logger=4, message=3,
        ),
        RegexFormat(
            "iso service",
            r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z?\s+.*",
            r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z?)\s+(\w+)\s+\d+\s+---\s+\[(.*?)\]\s*(?:\[(.*?)\]\s*)?(.*?)\s+:\s+(.*)$",
            "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
            level=2, thread=3, logger=5, message=6,
        ),
        Mixed(
            "database (mixed)",
            ["%d{yyyy-MM-dd HH:mm:ss,SSS} %level: %msg%n", "%d{yyyy-MM-dd HH:mm:ss.SSS} UTC [%t] %level %msg%n"],
        ),
        Layout("%h - - [%d{dd/MMM/yyyy:HH:mm:ss Z}] %msg%n"),
        RegexFormat(
            "bracketed time",
            r"^\[.*\] .*",
            r"^\[(.*?)\]\s+(\w+)\s+(.*)$",
            "yyyy-MM-dd HH:mm:ss",
            level=2, message=3,
        ),
    ]
