"""Statistics over whole tables: assembly sizes, enrichment, spectra, intervals of traces, false discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import numbers
from spanframe.operators.intervals import overlapping
from spanframe.operators.prefix import ranged, running


def assembly_stats(lengths: DataFrame) -> DataFrame:
    """One row for a column length: total, contigs, largest, n50, l50.

    Lengths are counted first; the running total goes over distinct lengths only.
    """
    counts = lengths.groupBy("length").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum(F.col("length") * F.col("n")).alias("total"), F.sum("n").alias("contigs"), F.max("length").alias("largest"))
    order = [F.col("length").desc()]
    run = running(ranged(counts, order, "lengths"), order, {"bases": ("sum", F.col("length") * F.col("n")), "taken": ("sum", F.col("n"))}).crossJoin(F.broadcast(totals))
    # The first length at which half of all bases is reached; of its contigs as many as are needed.
    hit = run.where("2 * bases >= total").agg(F.max_by(F.struct("length", "n", "bases", "taken", "total", "contigs", "largest"), "length").alias("x")).select("x.*")
    more = F.floor((F.col("bases") * 2 - F.col("total")) / (2 * F.col("length")))
    return hit.select("total", "contigs", "largest", F.col("length").alias("n50"), (F.col("taken") - more).cast("long").alias("l50"))


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """df with q, the adjusted probability. Distinct probabilities are ranked, not rows."""
    counts = df.groupBy(p).agg(F.count("*").alias("__n"))
    order = [F.col(p)]
    ranked = running(ranged(counts, order, "probabilities"), order, {"rank": ("sum", F.col("__n"))}).crossJoin(F.broadcast(df.agg(F.count("*").alias("m"))))
    raised = ranked.withColumn("x", F.col(p) * F.col("m") / F.col("rank"))
    adjusted = running(raised, [F.col(p).desc()], {"least": ("min", F.col("x"))}, backward=True).select(p, F.least(F.lit(1.0), "least").alias("q"))
    return df.join(adjusted, p)


def overlap_enrichment(a: DataFrame, b: DataFrame, space: int) -> DataFrame:
    """One row: how many of b's elements hit a, and how likely so many are by chance.

    An element of length l lands on a with probability of the summed (length + l - 1) of a's elements over the
    free places space - l + 1. Normal approximation of the sum of these trials, with its exact mean and variance.
    """
    sizes = a.agg(F.count("*").alias("na"), F.sum(F.col("end") - F.col("start")).alias("bases"))
    length = F.col("end") - F.col("start")
    p = F.least(F.lit(1.0), (F.col("bases") + F.col("na") * (length - 1)) / (F.lit(space) - length + 1))
    trials = b.crossJoin(F.broadcast(sizes)).withColumn("p", p).agg(F.count("*").alias("elements"), F.sum("p").alias("expected"), F.sum(F.col("p") * (1 - F.col("p"))).alias("variance"))
    hits = overlapping(b, a).agg(F.count("*").alias("hits"))
    out = trials.crossJoin(F.broadcast(hits))
    return out.select("elements", "hits", "expected", "variance", (F.col("hits") / F.col("expected")).alias("enrichment"), ((F.col("hits") - F.col("expected")) / F.sqrt("variance")).alias("z"))


def frequency_spectrum(sites: DataFrame) -> DataFrame:
    """Sites (derived, total) that segregate, by frequency: derived, total, sites, share."""
    kept = sites.where("derived > 0 and derived < total").groupBy("derived", "total").agg(F.count("*").alias("sites"))
    return kept.crossJoin(F.broadcast(kept.agg(F.sum("sites").alias("all")))).select("derived", "total", "sites", (F.col("sites") / F.col("all")).alias("share"))


def densest_interval(trace: DataFrame, share: float = 0.95, key: str = "chain", value: str = "value") -> DataFrame:
    """By key the mean, and the narrowest interval with that share of the values: key, mean, low, high.

    A chain's values are numbered in order; the interval's other end is a fixed number of rows ahead.
    """
    w = Window.partitionBy(key).orderBy(value)
    n = F.count("*").over(Window.partitionBy(key))
    numbered = trace.withColumn("__i", F.row_number().over(w)).withColumn("__n", n).withColumn("__mean", F.avg(value).over(Window.partitionBy(key)))
    ahead = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("__n")).cast("int"))
    ends = numbered.select(key, (F.col("__i") - ahead + 1).alias("__i"), F.col(value).alias("high"))
    pairs = numbered.join(ends, [key, "__i"]).withColumn("__width", F.col("high") - F.col(value))
    best = pairs.groupBy(key, "__mean").agg(F.min(F.struct("__width", value, "high")).alias("b"))
    return best.select(key, F.col("__mean").alias("mean"), F.col(f"b.{value}").alias("low"), F.col("b.high").alias("high"))


def term_enrichment(annotated: DataFrame, hits: DataFrame) -> DataFrame:
    """By term the P that so many hit genes carry it by chance.

    annotated: gene, term; hits: gene. P is the binomial right tail at the term's share of annotated genes.
    """
    genes = annotated.select("gene").distinct()
    total = genes.agg(F.count("*").alias("total"))
    drawn = hits.select("gene").distinct().join(genes, "gene", "left_semi")
    size = drawn.agg(F.count("*").alias("drawn"))
    pairs = annotated.select("gene", "term").distinct()
    found = pairs.join(drawn.withColumn("hit", F.lit(1)), "gene", "left").groupBy("term").agg(F.count("*").alias("genes"), F.count("hit").alias("hits"))
    rows = found.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(size))
    return rows.select("term", "genes", "hits", numbers.binomial_tail_column(F.col("drawn"), F.col("hits"), F.col("genes") / F.col("total")).alias("p"))


def fisher_tests(tables: DataFrame) -> DataFrame:
    """tables (a, b, c, d) with p, the one-sided probability; equal tables are tested once."""
    once = tables.select("a", "b", "c", "d").distinct()
    return tables.join(once.withColumn("p", numbers.fisher_exact_column(*[F.col(c) for c in "abcd"])), ["a", "b", "c", "d"])
