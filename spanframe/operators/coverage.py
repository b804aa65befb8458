"""Coverage and signal tracks.

A track has the columns chrom, pos, value; positions without a row are missing. Coverage comes from a sweep
over interval ends (+1 and -1), never from a row for each base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage_segments(df: DataFrame) -> DataFrame:
    """Runs of constant positive depth: chrom, start, end, depth. Ends are summed before the window."""
    ends = df.where("end > start").select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("chrom", "x.pos").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("chrom").orderBy("pos")
    swept = steps.select("chrom", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return swept.where("depth > 0")


def depth_histogram(df: DataFrame) -> DataFrame:
    """Positions at each depth: depth, positions."""
    return coverage_segments(df).groupBy("depth").agg(F.sum(F.col("end") - F.col("start")).alias("positions"))


def window_coverage(df: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """Sum over depth of covered positions in consecutive windows of each chromosome: chrom, start, covered.

    Overlapping intervals count repeatedly. A constant-depth run is cut at window bounds and summed.
    """
    runs = coverage_segments(df)
    cut = runs.select("chrom", "start", "end", "depth", F.explode(F.sequence(F.expr(f"start div {window}"), F.expr(f"(end - 1) div {window}"))).alias("w"))
    part = F.least("end", (F.col("w") + 1) * window) - F.greatest("start", F.col("w") * window)
    return cut.join(sizes.select("chrom"), "chrom", "left_semi").groupBy("chrom", (F.col("w") * window).alias("start")).agg(F.sum(part * F.col("depth")).alias("covered"))


def sliding_coverage(df: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """Covered positions in [x, x + window) for every x at which the count's slope changes: chrom, x, covered.

    Between two such x the count is linear, so they determine it everywhere; repeated overlaps count again.
    """
    runs = coverage_segments(df)
    ends = runs.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("p"), F.col("depth").alias("d")), F.struct(F.col("end").alias("p"), (-F.col("depth")).alias("d")))).alias("e"))
    moves = ends.select("chrom", F.explode(F.array(F.struct((F.col("e.p") - window).alias("x"), F.col("e.d").alias("slope")), F.struct(F.col("e.p").alias("x"), (-F.col("e.d")).alias("slope")))).alias("m"))
    steps = moves.groupBy("chrom", "m.x").agg(F.sum("m.slope").alias("slope"))
    w = Window.partitionBy("chrom").orderBy("x")
    sloped = steps.withColumn("run", F.sum("slope").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("before", F.lag("run").over(w))
    valued = sloped.withColumn("covered", F.sum(F.coalesce(F.col("before") * F.col("dx"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return valued.join(sizes, "chrom").where((F.col("x") >= 0) & (F.col("x") + window <= F.col("size"))).select("chrom", "x", "covered")


def region_values(regions: DataFrame, track: DataFrame, tile: int = 256) -> DataFrame:
    """For each row of regions: its coordinates, the least, largest and mean track value inside, and their number, positions.

    A region without a value has nulls and 0 positions; equal regions each have a row.

    Regions are cut at tiles, which bounds a region's rows by its length over the tile; the tiles are joined on
    (chrom, tile).
    """
    keys = regions.select("chrom", "start", "end").distinct()
    cut = keys.where("end > start").select("*", F.explode(F.sequence(F.expr(f"start div {tile}"), F.expr(f"(end - 1) div {tile}"))).alias("tile"))
    points = track.select(F.col("chrom").alias("c"), "pos", "value", F.expr(f"pos div {tile}").alias("t"))
    met = cut.join(points, (F.col("chrom") == F.col("c")) & (F.col("tile") == F.col("t")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    found = met.groupBy("chrom", "start", "end").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count("*").alias("positions"))
    out = regions.select("chrom", "start", "end").join(found, ["chrom", "start", "end"], "left")
    return out.select("chrom", "start", "end", "low", "high", "mean", F.coalesce("positions", F.lit(0)).cast("long").alias("positions"))


def smooth(track: DataFrame, window: int, last_window: bool = True) -> DataFrame:
    """Moving average over window consecutive positions, at the window's centre; none where one is missing.

    Sums come from a running total, so the cost does not grow with the window. last_window: whether the window
    that ends at the chromosome's last position counts.
    """
    w = Window.partitionBy("chrom").orderBy("pos")
    total = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    summed = track.withColumn("__t", total).withColumn("__before", F.coalesce(F.lag("__t", window).over(w), F.lit(0.0))).withColumn("__first", F.lag("pos", window - 1).over(w))
    if not last_window:
        summed = summed.withColumn("__end", F.max("pos").over(Window.partitionBy("chrom"))).where("pos < __end").drop("__end")
    full = summed.where(F.col("pos") - F.col("__first") == window - 1)
    return full.select("chrom", (F.col("__first") + window // 2).alias("pos"), ((F.col("__t") - F.col("__before")) / window).alias("value"))


def combine(a: DataFrame, b: DataFrame, op: str, missing: float = 0.0) -> DataFrame:
    """Elementwise add, subtract, multiply, divide, max or min of two tracks; positions in one only use missing."""
    x, y = F.coalesce(F.col("x"), F.lit(missing)), F.coalesce(F.col("y"), F.lit(missing))
    value = {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.try_divide(x, y), "max": F.greatest(x, y), "min": F.least(x, y)}[op]
    joined = a.select("chrom", "pos", F.col("value").alias("x")).join(b.select("chrom", "pos", F.col("value").alias("y")), ["chrom", "pos"], "full")
    return joined.select("chrom", "pos", value.alias("value"))


def scale(track: DataFrame, factor: float = 1.0, offset: float = 0.0) -> DataFrame:
    return track.withColumn("value", F.col("value") * factor + offset)


def clip(track: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values under low or over high are replaced by the bound."""
    v = F.col("value")
    v = F.greatest(v, F.lit(low)) if low is not None else v
    v = F.least(v, F.lit(high)) if high is not None else v
    return track.withColumn("value", v)


def mask(track: DataFrame, low: float, high: float) -> DataFrame:
    """Rows with values in [low, high]; the others become missing."""
    return track.where(F.col("value").between(low, high))


def pearson(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: correlation over the positions that both tracks have."""
    joined = a.select("chrom", "pos", F.col("value").alias("x")).join(b.select("chrom", "pos", F.col("value").alias("y")), ["chrom", "pos"])
    return joined.agg(F.corr("x", "y").alias("r"), F.count("*").alias("positions"))


def value_histogram(track: DataFrame) -> DataFrame:
    """Positions by value, cut to an integer towards zero."""
    return track.groupBy(F.col("value").cast("long").alias("bin")).agg(F.count("*").alias("positions"))


def track_stats(track: DataFrame) -> DataFrame:
    """By chromosome: positions, least, largest and mean value, and their standard deviation."""
    return track.groupBy("chrom").agg(F.count("*").alias("positions"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def expand_ranges(df: DataFrame, value: str = "value") -> DataFrame:
    """Ranges (chrom, start, end, value) to one row for each position. The result is as long as the ranges are."""
    return df.where("end > start").select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), F.col(value).alias("value"))


def to_ranges(track: DataFrame) -> DataFrame:
    """Runs of consecutive positions with equal values: chrom, start, end, value."""
    w = Window.partitionBy("chrom", "value").orderBy("pos")
    runs = track.withColumn("__run", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("chrom", "value", "__run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).select("chrom", "start", "end", "value")


def runs_of(track: DataFrame, longest: int = 1 << 16) -> DataFrame:
    """track with run, a number that rows of consecutive positions share; runs also end at multiples of longest, so they stay bounded.

    Positions are numbered within tiles of that length, not within whole chromosomes.
    """
    tile = F.floor(F.col("pos") / longest)
    return track.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("chrom", tile).orderBy("pos")))
