"""Step-by-step projections: each intermediate result is computed once per row."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ids = count()


class Steps:
    """Adds helper columns to a DataFrame and drops them at the end.

    An expression that uses an expensive part many times would evaluate it many times. ``let`` gives the
    part its own projection, which the optimizer keeps apart as long as it is used more than once.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._names: list[str] = []

    def let(self, value: Column) -> Column:
        name = f"_step{next(_ids)}"
        self.df = self.df.withColumn(name, value)
        self._names.append(name)
        return F.col(name)

    def finish(self, **columns: Column) -> DataFrame:
        """The DataFrame with ``columns`` added and the helpers removed.

        The columns come out of a one-row generator. It keeps later filters on them from being written
        out in terms of all the steps below, where every step would be repeated many times.
        """
        keep = [c for c in self.df.columns if c not in self._names and c not in columns]
        made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
        return self.df.select(*keep, made)
