"""Text export of views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.fields import safe_file_name
from logweave.operators.timeline import ORDER


def _ordered(entries: DataFrame, *first: str) -> DataFrame:
    return entries.orderBy(*first, *[c for c in ORDER if c in entries.columns])


def export_view(entries: DataFrame, path: str, compression: str = "none") -> None:
    """Write the raw text of all entries in time order, one newline after each.

    The parts of the folder, read in name order, give the whole text.
    """
    _ordered(entries).select("raw").write.option("compression", compression).text(path)


def export_views(entries: DataFrame, path: str, compression: str = "none", view: str = "view") -> None:
    """Write many views at once, one folder ``view_file=<safe title>.log`` per view.

    The sort splits by range, so a large view is written by many tasks, its parts in name order.
    """
    named = entries.withColumn("view_file", F.concat(safe_file_name(F.col(view)), F.lit(".log")))
    _ordered(named, "view_file").select("raw", "view_file").write.partitionBy("view_file").option(
        "compression", compression
    ).text(path)
