"""Benchmark decontamination by templates, in DataFrame operations only.

Numbers, units and names become typed placeholders, so a question with other numbers or names keeps its template. Windows
of five template words are joined by hash; documents that cover enough of an item's windows are looked at again with
the words that stand in the slots, which must correspond consistently. Items of fewer words are found verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import fresh, stored, whole_text
from logweave.session import small_side

WINDOW = 5
COVERED = 0.8
CONSISTENT = 0.8
# More benchmark windows than this are joined by shuffle.
BROADCAST_WINDOWS = 500_000

# Units that may follow a number.
UNITS = (
    "km cm mm m kg g mg lb lbs oz l ml mi ft in s sec min h hr hrs hours days weeks months years miles meters metres "
    "kilometers grams kilograms liters litres minutes seconds dollars cents euros usd eur percent"
).split()

NUMBER, UNIT, NAME = "#num", "#unit", "#name"

# What a verbatim find of a short item says of windows and slots.
_COUNTS = ("n_windows", "n_matched", "n_slots", "n_consistent", "n_changed")


def _broadcast(side: DataFrame, most: int = 200_000) -> DataFrame:
    """``side`` for broadcast if it has few rows, else as it is for a shuffle join."""
    marked = small_side(side, most)
    return side if marked is None else marked


def raw_words(text: Column) -> Column:
    """All words of the text with one blank before, between and after them."""
    spaced = F.translate(F.concat(F.lit(" "), text, F.lit(" ")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaced, " {2,}", " ")


def template(raw: Column) -> Column:
    """``raw_words`` with typed placeholders; each word gives one template word, which is empty for punctuation alone.

    A capitalised word inside a sentence (after a letter, digit, comma or semicolon) is a name, a word of digits and
    punctuation a number, a unit after a number a unit. All else is in small letters without punctuation at its edges.
    """
    # Patterns start with the blank before a word or a plain class, so that most places fail at their first character.
    text = F.translate(raw, "#", "-")
    text = F.lower(F.regexp_replace(text, r" (?<=[\p{L}\p{N},;] )\p{Lu}[^ ]*", f" {NAME}"))
    text = F.regexp_replace(text, r" [^\p{L}\p{N} #]*[0-9][^\p{L} #]*(?= )", f" {NUMBER}")
    text = F.regexp_replace(text, rf"{NUMBER} (?:{'|'.join(UNITS)})[^\p{{L}}\p{{N}} #]*(?= )", f"{NUMBER} {UNIT}")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}# ]+(?= )", "")
    return F.regexp_replace(text, r" [^\p{L}\p{N}# ]+", " ")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it and even inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    """The words of a text with a blank at both ends; none of a blank text."""
    none = F.array().cast("array<string>")

    def inner(t: Column) -> Column:
        return F.when(F.length(t) <= 1, none).otherwise(F.split(F.substring(t, F.lit(2), F.length(t) - 2), " "))

    return _let(text, inner)


def bare(raw: Column) -> Column:
    """``raw_words`` in small letters without punctuation at their edges, without placeholders."""
    return F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N} ]+(?= )|(?<= )[^\p{L}\p{N} ]+", "")


def _windows(words: Column, size: int = WINDOW) -> Column:
    """Hashes of all windows of ``size`` words; none of a shorter text."""
    none = F.array().cast("array<bigint>")

    def inner(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - size)
        many = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) >= size, many).otherwise(none)

    return _let(words, inner)


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items as (item_id, variant, raw, words, windows). Inside a document an item's first word stands within a sentence or at
    its start, so each item has a variant for either. Items of fewer than ``WINDOW`` words have no windows and are left out."""
    items = benchmark.select(F.col(id_col).alias("item_id"), whole_text(text_col).alias("text"))
    items = items.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    raw = raw_words(F.col("text"))
    led = F.concat(F.lit(" a"), raw)
    within = F.substring(template(led), F.lit(3), F.length(template(led)))
    items = items.select("item_id", "variant", raw.alias("raw"), F.when(F.col("variant") == 0, template(raw)).otherwise(within).alias("line"))
    items = items.select("item_id", "variant", _words(F.col("raw")).alias("raw"), _words(F.col("line")).alias("words"))
    return items.withColumn("windows", _windows(F.col("words"))).filter(F.size("windows") > 0)


def _short(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold an item of fewer than ``WINDOW`` words, all of them in a row, in the columns of :func:`_slots`."""
    items = benchmark.select("item_id", _words(bare(raw_words(whole_text("text")))).alias("words"))
    items = stored(items.filter((F.size("words") > 0) & (F.size("words") < WINDOW)).distinct(), "leak-short")
    sizes = sorted(r[0] for r in items.select(F.size("words")).distinct().collect())
    counts = [F.lit(1 if c in ("n_windows", "n_matched") else 0).alias(c) for c in _COUNTS]
    if not sizes:
        none = T.StructType(docs.select("doc_id").schema.fields + items.select("item_id").schema.fields)
        return docs.sparkSession.createDataFrame([], none).select("doc_id", "item_id", *counts)
    keys = items.select("item_id", F.xxhash64(F.lit(0), F.concat_ws(" ", "words")).alias("window"))
    rows = docs.select("doc_id", _words(bare(raw_words(whole_text("text")))).alias("words"))

    def runs(w: Column) -> Column:
        none = F.array().cast("array<bigint>")

        def of(n: int) -> Column:
            at = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.lit(0), F.concat_ws(" ", F.slice(w, i, n))))
            return F.when(F.size(w) >= n, at).otherwise(none)

        return F.array_distinct(F.concat(*[of(n) for n in sizes]))

    found = rows.select("doc_id", F.explode(_let(F.col("words"), runs)).alias("window")).join(_broadcast(keys), "window")
    return found.select("doc_id", "item_id").distinct().select("doc_id", "item_id", *counts)


def _document_windows(docs: DataFrame) -> DataFrame:
    """doc_id, words (raw), template words and window hashes of whole texts."""
    rows = docs.select("doc_id", raw_words(whole_text("text")).alias("raw"))
    rows = rows.select("doc_id", "raw", _words(template(F.col("raw"))).alias("words"))
    return rows.select("doc_id", "raw", "words", _windows(F.col("words")).alias("windows"))


def _covered(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, variant, n_windows, n_matched) of documents that hold enough of an item's distinct windows."""
    sizes = items.select("item_id", "variant", F.size(F.array_distinct("windows")).alias("n_windows"))
    keys = items.select("item_id", "variant", F.explode(F.array_distinct("windows")).alias("window"))
    found = _document_windows(docs).select("doc_id", F.explode("windows").alias("window"))
    found = found.join(_broadcast(keys, BROADCAST_WINDOWS), "window")
    # Partial aggregates: a window that every copy holds is reduced in the map tasks.
    found = found.groupBy("doc_id", "item_id", "variant", "window").agg(F.lit(1).alias("one"))
    found = found.groupBy("doc_id", "item_id", "variant").agg(F.count("one").alias("n_matched"))
    return found.join(sizes, ["item_id", "variant"]).filter(F.col("n_matched") >= COVERED * F.col("n_windows"))


def _slots(docs: DataFrame, items: DataFrame, covered: DataFrame) -> DataFrame:
    """Adds n_slots, n_consistent and n_changed to ``covered``, for each alignment that holds nearly as many of the item's windows
    as the best one.

    A slot is consistent if its item value has the same document value at its first slot. Only covered pairs get here.
    """
    ids = covered.select("doc_id").distinct()
    wanted = _broadcast(ids)
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.doc_id), "left_semi")
    texts = _document_windows(texts).select("doc_id", F.monotonically_increasing_id().alias("row"), "raw", "windows")
    texts = stored(texts.select("doc_id", "row", _words(F.col("raw")).alias("doc_raw"), "windows"), "leak-texts")
    pairs = texts.join(covered.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own"))).drop("own")
    marked = items.select("item_id", "variant", F.posexplode("windows").alias("q", "window"))
    places = pairs.select("row", "item_id", "variant", F.posexplode("windows").alias("p", "window"))
    lines = places.join(marked, ["item_id", "variant", "window"]).withColumn("shift", F.col("p") - F.col("q"))
    lines = lines.groupBy("row", "item_id", "variant", "shift").agg(F.collect_set("q").alias("places"))
    best = F.max(F.size("places")).over(Window.partitionBy("row", "item_id"))
    lines = lines.withColumn("best", best).filter(F.size("places") >= COVERED * F.col("best")).drop("best")
    lines = lines.join(items.select("item_id", "variant", F.col("raw").alias("item_raw"), "words"), ["item_id", "variant"])
    lines = lines.join(pairs.select("row", "item_id", "variant", "doc_id", "doc_raw", "n_windows", "n_matched"), ["row", "item_id", "variant"])
    at = F.array_distinct(F.flatten(F.transform("places", lambda q: F.sequence(q, q + WINDOW - 1))))
    at = F.array_sort(F.filter(at, lambda k: F.startswith(F.get("words", k), F.lit("#"))))
    slots = F.transform(at, lambda k: F.struct(F.get("item_raw", k).alias("v"), F.get("doc_raw", k + F.col("shift")).alias("d")))

    def same(all_: Column) -> Column:
        return F.filter(all_, lambda s: F.get(F.filter(all_, lambda x: x["v"] == s["v"]), F.lit(0))["d"] == s["d"])

    def counts(all_: Column) -> Column:
        changed = F.size(F.filter(all_, lambda s: s["v"] != s["d"]))
        return F.struct(F.size(all_).alias("n_slots"), F.size(same(all_)).alias("n_consistent"), changed.alias("n_changed"))

    return lines.select("doc_id", "item_id", "n_windows", "n_matched", _let(slots, counts).alias("c")).select(
        "doc_id", "item_id", "n_windows", "n_matched", "c.*"
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item, one row per pair: doc_id, item_id, n_windows, n_matched, coverage, n_slots,
    n_consistent, n_changed (slots whose value differs: 0 for a verbatim copy).

    A document holds an item if it has at least ``COVERED`` of the item's windows and in one alignment at least ``CONSISTENT``
    of the slots agree: equal values of the item have equal values in the document. An item of fewer than ``WINDOW`` words is
    held by documents with all its words in a row, letter case and punctuation at the edges of words aside. ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are not read. Null and
    empty texts hold nothing and are never held; rows with one id, also with none, are one document; repeated items are one.
    Empty tables give no rows.
    """
    benchmark = benchmark.select("item_id", "text").distinct()
    items = stored(benchmark_items(benchmark), "leak-items")
    covered = stored(_covered(docs, items), "leak-covered")
    found = _slots(docs, items, covered).filter(F.col("n_consistent") >= CONSISTENT * F.col("n_slots"))
    found = found.unionByName(_short(docs, benchmark))
    ranked = F.max_by(F.struct("n_windows", "n_matched", "n_slots", "n_consistent", "n_changed"), F.struct("n_matched", -F.col("n_changed")))
    found = found.groupBy("doc_id", "item_id").agg(ranked.alias("best")).select("doc_id", "item_id", "best.*")
    return found.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that hold no benchmark item, columns unchanged.

    Rows that share an id, also a null one, go or stay together; null and empty texts stay, and all rows stay if either table is
    empty; repeated rows stay repeated.
    """
    name = fresh("_leaked", docs.columns)
    bad = stored(leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "leak-ids")
    return docs.join(_broadcast(bad), docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
