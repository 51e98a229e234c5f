"""Faceted options: which filter values are still available under the other filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.predicates import FACETS, all_of, row_filter, valid_regex
from logweave.operators.profile import entry_once


def _options(df: DataFrame, values: Mapping[str, Column], conditions: Mapping[str, Column | None]) -> DataFrame:
    """(facet, value, total, n): entries with the value, and those that pass all other conditions.

    One scan and one shuffle for all facets; counts are combined before the shuffle.
    """
    rows = [
        F.struct(
            F.lit(name).alias("facet"),
            value.alias("value"),
            all_of(*[c for other, c in conditions.items() if other != name]).alias("passes"),
        )
        for name, value in values.items()
    ]
    return (
        df.filter(entry_once(df)).select(F.inline(F.array(*rows)))
        .filter(F.col("value") != "")
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("passes").alias("n"))
    )


def facet_options(
    df: DataFrame,
    selections: Mapping[str, Iterable[str]] | None = None,
    message: str = "",
    domains: Mapping[str, Iterable[str]] | None = None,
    ignore_case: bool = True,
) -> DataFrame:
    """Available values of level, thread, logger, ip and source: (facet, value, n).

    A value is available if a row has it and passes the filters of all other facets.
    """
    return all_options(df, selections, message, domains, ignore_case).filter(F.col("n") > 0).drop("total")


def all_options(df, selections=None, message="", domains=None, ignore_case=True) -> DataFrame:
    """The whole domain of each facet: (facet, value, total, n); ``n`` is 0 for an unavailable value."""
    if message and not valid_regex(df, message):
        message = ""
    conditions = row_filter(selections, message, domains, ignore_case)
    return _options(df, {f: v() for f, v in FACETS.items()}, conditions)


def option_list(options: DataFrame, show_unavailable: bool = True) -> DataFrame:
    """Options in alphabetical order, with the unavailable ones flagged or left out."""
    listed = options.withColumn("available", F.col("n") > 0)
    if not show_unavailable:
        listed = listed.filter("available")
    return listed.select("facet", "value", "available").orderBy("facet", "value")
