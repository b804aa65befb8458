"""Row-local rewriting and filtering of interval rows, and small set operations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.prefix import ranged, running


def midpoint(df: DataFrame) -> DataFrame:
    """The one position in the middle, rounded down."""
    mid = F.expr("(start + end) div 2")
    return df.withColumns({"start": mid, "end": mid + 1})


def tss(df: DataFrame) -> DataFrame:
    """The strand's first position; a row without a strand is an error."""
    bad = F.raise_error(F.lit("a region has no strand")).cast("long")
    start = F.when(F.col("strand") == "+", F.col("start")).when(F.col("strand") == "-", F.col("end") - 1).otherwise(bad)
    return df.withColumn("start", start).withColumn("end", F.col("start") + 1)


def trim(df: DataFrame, left: int, right: int) -> DataFrame:
    """Cuts positions off both ends; nothing left of a region is an error."""
    start, end = F.col("start") + left, F.col("end") - right
    checked = F.when(start < end, start).otherwise(F.raise_error(F.lit("a region is trimmed to nothing")).cast("long"))
    return df.withColumns({"start": checked, "end": end})


def trim_percent(df: DataFrame, percent: float) -> DataFrame:
    """Cuts a share of the length, the odd position from the left; regions cut to nothing are dropped."""
    gone = F.round((F.col("end") - F.col("start")) * percent / 100.0).cast("long")
    return df.withColumns({"start": F.col("start") + gone - F.expr("0") - F.floor(gone / 2), "end": F.col("end") - F.floor(gone / 2)}).where("end > start")


def pad(df: DataFrame, upstream: int = 0, downstream: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """Widens regions along their strand (no strand counts as +), within [0, chromosome size)."""
    plus = F.coalesce(F.col("strand") if "strand" in df.columns else F.lit("+"), F.lit("+")) != "-"
    left, right = F.when(plus, F.lit(upstream)).otherwise(F.lit(downstream)), F.when(plus, F.lit(downstream)).otherwise(F.lit(upstream))
    wide = df.withColumns({"start": F.greatest(F.lit(0), F.col("start") - left), "end": F.col("end") + right})
    if sizes is None:
        return wide
    return wide.join(sizes.select("chrom", "size"), "chrom").withColumn("end", F.least("end", "size")).drop("size")


def shear(df: DataFrame, size: int) -> DataFrame:
    """Cuts each region into pieces of size positions, the last one shorter; piece counts from 0."""
    pieces = df.where("end > start").withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((end - start - 1) div {size} as int)"))))
    return pieces.withColumn("__s", F.col("start") + F.col("piece") * size).withColumn("end", F.least("end", F.col("__s") + size)).withColumn("start", F.col("__s")).drop("__s")


def filter_regions(df: DataFrame, min_score: int | None = None, max_score: int | None = None, min_length: int | None = None, max_length: int | None = None, min_start: int | None = None, max_start: int | None = None, min_end: int | None = None, max_end: int | None = None, chrom: str | None = None, name: str | None = None, share: float | None = None, seed: int = 1) -> DataFrame:
    """All given conditions hold; a row without a score fails any bound on it. share: a Bernoulli sample."""
    length = F.col("end") - F.col("start")
    tests: list[Column] = []
    for value, low, high in ((F.col("score") if "score" in df.columns else F.lit(None).cast("int"), min_score, max_score), (length, min_length, max_length), (F.col("start"), min_start, max_start), (F.col("end"), min_end, max_end)):
        tests += [value >= low] if low is not None else []
        tests += [value <= high] if high is not None else []
    tests += [F.col("chrom") == chrom] if chrom is not None else []
    tests += [F.col("name") == name] if name is not None else []
    kept = df.where(reduce(and_, tests)) if tests else df
    return kept.sample(fraction=share, seed=seed) if share is not None else kept


def unique_regions(df: DataFrame) -> DataFrame:
    """Coordinates that occur, each once."""
    return df.select("chrom", "start", "end").distinct()


def distance_from_ends(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """score: the distance to the nearer end of the chromosome."""
    return df.join(sizes.select("chrom", "size"), "chrom").withColumn("score", F.least(F.col("start"), F.col("size") - F.col("end"))).drop("size")


def exact_math(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """plus, minus, times or divideBy of the values of regions with equal coordinates.

    Each row of a matches; of b's rows with equal coordinates the one with the least value counts.
    """
    first = b.groupBy("chrom", "start", "end").agg(F.min("value").alias("__b"))
    v, w = F.col("value"), F.col("__b")
    value = {"plus": v + w, "minus": v - w, "times": v * w, "divideBy": F.try_divide(v, w)}[op]
    return a.join(first, ["chrom", "start", "end"]).select("chrom", "start", "end", value.alias("value"))


def distance_to_named(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance from each row of a to the one row of b with its name; -1 across chromosomes.

    Names that b has not exactly once are errors. Overlap is 0, touching 1.
    """
    once = b.groupBy("name").agg(F.count("*").alias("__n"), F.min("chrom").alias("b_chrom"), F.min("start").alias("b_start"), F.min("end").alias("b_end"))
    joined = a.join(once, "name", "left")
    gap = F.greatest(F.lit(0), F.greatest("start", "b_start") - F.least("end", "b_end") + 1)
    bad = F.raise_error(F.concat(F.lit("not exactly one region is named "), F.col("name"))).cast("long")
    return joined.withColumn("distance", F.when(F.coalesce(F.col("__n"), F.lit(0)) != 1, bad).when(F.col("chrom") == F.col("b_chrom"), gap).otherwise(F.lit(-1))).drop("__n")


def fdr_by_rank(df: DataFrame, value: str = "value") -> DataFrame:
    """df with fdr: value is -log10 of a probability, fdr that of the probability times (rows / rank), 0 at least.

    A value's rank is the number of rows with a value at least as large. Values are counted first, so distinct values
    are ranked, in ranges.
    """
    order = [F.col(value).desc()]
    counts = ranged(df.groupBy(value).agg(F.count("*").alias("__n")), order, "fdr")
    ranks = running(counts, order, {"rank": ("sum", F.col("__n"))}).select(value, "rank")
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    return df.join(ranks, value).crossJoin(total).withColumn("fdr", F.greatest(F.lit(0.0), F.col(value) - F.log10(F.col("total") / F.col("rank")))).drop("total")


def coordinate_sort(df: DataFrame, *ties: str) -> DataFrame:
    """By chromosome in byte order, start, end, then ties. A range exchange and a spilling sort."""
    return df.orderBy("chrom", "start", "end", *ties)
