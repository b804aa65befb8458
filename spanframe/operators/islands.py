"""Gaps and islands: merging, inversion, peaks and distances in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_islands(df: DataFrame, pad: int = 0) -> DataFrame:
    """df with ``island``, the number within the chromosome of the merged region that a row belongs to.

    Rows join an island if they overlap it or start within pad of its end. One shuffle by chromosome serves
    the window functions and a following groupBy on (chrom, island).
    """
    before = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("start") >= F.max("end").over(before) + pad), F.lit(True)) if pad else F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    return df.withColumn("__opens", opens.cast("int")).withColumn("island", F.sum("__opens").over(so_far)).drop("__opens")


def merge_intervals(df: DataFrame, *aggs: Column, pad: int = 0) -> DataFrame:
    """One row for each island: chrom, start, end and the given aggregates of its rows.

    pad: intervals with fewer than pad positions between them are merged too.
    """
    return with_islands(df, pad).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggs).drop("island")


def merged_names(column: str = "name", separator: str = ",") -> Column:
    """The names of an island's rows, distinct, in byte order."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def self_overlaps(df: DataFrame) -> DataFrame:
    """One row: whether any two rows overlap."""
    w = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return df.select((F.col("start") < F.max("end").over(w)).alias("o")).agg(F.coalesce(F.max("o"), F.lit(False)).alias("self_overlapping"))


def invert(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """The uncovered regions of each chromosome in sizes (chrom, size)."""
    merged = merge_intervals(df)
    edges = merged.select("chrom", "start", "end").union(sizes.select("chrom", F.col("size").alias("start"), F.col("size").alias("end")))
    w = Window.partitionBy("chrom").orderBy("start", "end")
    gaps = edges.select("chrom", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("start"), F.col("start").alias("end"))
    return gaps.where("end > start").join(sizes.select("chrom"), "chrom", "left_semi")


def peaks(track: DataFrame, threshold: float, minima: bool = False) -> DataFrame:
    """Runs of consecutive positions whose value reaches threshold (stays under it for minima).

    track: chrom, pos, value. Result: chrom, start, end, score: the largest (least) value, cut to an integer.
    """
    kept = track.where(F.col("value") <= threshold if minima else F.col("value") >= threshold)
    w = Window.partitionBy("chrom").orderBy("pos")
    runs = kept.withColumn("__run", F.col("pos") - F.row_number().over(w))
    best = F.min("value") if minima else F.max("value")
    return runs.groupBy("chrom", "__run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.expr("0").alias("__x"), best.alias("__v")).select("chrom", "start", "end", F.col("__v").cast("long").alias("score"))


def min_distance_filter(df: DataFrame, least: int) -> DataFrame:
    """Positions (chrom, pos) at least that far from both neighbours; of close ones both go."""
    w = Window.partitionBy("chrom").orderBy("pos")
    marked = df.withColumn("__b", F.col("pos") - F.lag("pos").over(w)).withColumn("__a", F.lead("pos").over(w) - F.col("pos"))
    return marked.where(F.coalesce(F.col("__b") >= least, F.lit(True)) & F.coalesce(F.col("__a") >= least, F.lit(True))).drop("__a", "__b")


def nearest(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """For each query position (chrom, pos) the nearest target position; of two as near the left one.

    One window over the union of both sides per direction, no join. Result: chrom, pos, left_pos, right_pos,
    nearest_pos.
    """
    q = queries.select("chrom", "pos", F.lit(True).alias("is_query"))
    t = targets.select("chrom", "pos", F.lit(False).alias("is_query"))
    both = q.union(t)
    back = Window.partitionBy("chrom").orderBy("pos", F.col("is_query")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("chrom").orderBy(F.col("pos").desc(), F.col("is_query")).rowsBetween(Window.unboundedPreceding, 0)
    target = F.when(~F.col("is_query"), F.col("pos"))
    found = both.withColumn("left_pos", F.last(target, ignorenulls=True).over(back)).withColumn("right_pos", F.last(target, ignorenulls=True).over(ahead)).where("is_query")
    near = F.when(F.col("right_pos").isNull() | (F.col("pos") - F.col("left_pos") <= F.col("right_pos") - F.col("pos")), F.col("left_pos")).otherwise(F.col("right_pos"))
    return found.select("chrom", "pos", "left_pos", "right_pos", near.alias("nearest_pos"))


def assign_space(features: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles each chromosome: every base goes to its nearest feature position, ties to the left one.

    features: chrom, pos, name. Result: chrom, start, end, name.
    """
    one = features.groupBy("chrom", "pos").agg(F.min("name").alias("name"))
    w = Window.partitionBy("chrom").orderBy("pos")
    split = one.withColumn("__next", F.lead("pos").over(w)).withColumn("__before", F.lag("pos").over(w)).join(sizes.select("chrom", "size"), "chrom")
    middle = lambda a, b: F.expr(f"({a} + {b}) div 2 + 1")
    return split.select("chrom", F.coalesce(middle("__before", "pos"), F.lit(0)).alias("start"), F.coalesce(middle("pos", "__next"), F.col("size")).alias("end"), "name")
