"""Seeded simulation: regions, sequences and genotypes from hashes of row numbers, alike on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*key: Column | int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    columns = [F.lit(k) if isinstance(k, int) else k for k in key]
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def random_regions(spark: SparkSession, n: int, sizes: list[tuple[str, int]], length: int, seed: int = 1) -> DataFrame:
    """n regions of one length, uniform over all places of the chromosomes: chrom, start, end, name."""
    fitting = [(c, s - length + 1) for c, s in sizes if s >= length]
    total = sum(s for _, s in fitting)
    rows = spark.range(n).withColumn("__u", F.floor(uniform(F.col("id"), seed) * total).cast("long"))
    chrom, start, low = F.lit(None).cast("string"), F.lit(None).cast("long"), 0
    for name, places in fitting:
        inside = (F.col("__u") >= low) & (F.col("__u") < low + places)
        chrom, start = F.when(inside, F.lit(name)).otherwise(chrom), F.when(inside, F.col("__u") - low).otherwise(start)
        low += places
    return rows.select(chrom.alias("chrom"), start.alias("start"), (start + length).alias("end"), F.concat(F.lit("region_"), F.col("id")).alias("name"))


def random_sequences(spark: SparkSession, n: int, length: int, gc: float = 0.5, seed: int = 1) -> DataFrame:
    """n sequences with an expected share of G and C: name, seq."""
    u = lambda i: uniform(F.col("id"), i, F.lit(seed))
    base = lambda i: F.when(u(i) < gc / 2, "G").when(u(i) < gc, "C").when(u(i) < gc + (1 - gc) / 2, "A").otherwise("T")
    return spark.range(n).select(F.concat(F.lit("seq_"), F.col("id")).alias("name"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "").alias("seq"))


def drift(populations: DataFrame, size: int, generations: int, seed: int = 1) -> DataFrame:
    """Neutral drift of allele frequencies (id, frequency) over generations, by the normal form of sampling."""
    p = F.col("frequency")
    for g in range(generations):
        spread = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / (2.0 * size))
        normal = F.sqrt(-2 * F.ln(F.greatest(uniform(F.col("id"), F.lit(2 * g), F.lit(seed)), F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * uniform(F.col("id"), F.lit(2 * g + 1), F.lit(seed)))
        populations = populations.withColumn("frequency", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + spread * normal)))
        p = F.col("frequency")
    return populations
