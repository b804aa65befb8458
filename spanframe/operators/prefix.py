"""Running totals over a whole table, in as many tasks as it has ranges.

A window without a partition puts all rows into one task. Here rows are dealt by ranges of their order and written; each
range is scanned by itself, and what earlier ranges hold is added to it. Only one row for each range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.scratch import Scratch

RANGE = "__range"


def ranged(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df written in ranges of the order; the column ``__range`` counts them. Equal rows may lie on either side of a bound."""
    dealt = df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id())
    return Scratch(df.sparkSession, label).keep(dealt, "ranges")


def running(rows: DataFrame, order: list[Column], carry: dict[str, tuple[str, Column]], backward: bool = False) -> DataFrame:
    """rows, from ``ranged``, with running sums, minima or maxima in the order, this row's included.

    carry: by name ("sum", "min" or "max", what is taken of each row). backward: from the last row; the order given is then the
    reverse of the ranges' own, for a frame that ends at the current row is summed as it grows.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    own = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(F.col(RANGE).desc() if backward else F.col(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(RANGE).agg(*[fold[how](x).alias(f"__{name}") for name, (how, x) in carry.items()])
    carried = totals.select(RANGE, *[fold[how](f"__{name}").over(before).alias(f"__{name}") for name, (how, _) in carry.items()])
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    out = rows.join(F.broadcast(carried), RANGE)  # one row a range
    return out.withColumns({name: both[how](fold[how](x).over(own), F.col(f"__{name}")) for name, (how, x) in carry.items()}).drop(*[f"__{name}" for name in carry])
