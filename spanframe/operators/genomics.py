"""Liftover, variants, alignments and sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import sequence
from spanframe.operators.annotation import occurrences
from spanframe.operators.intervals import met_sums, overlap_join


def lift(regions: DataFrame, blocks: DataFrame, min_match: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Maps regions through ungapped blocks; (mapped, unmapped with a reason).

    blocks: chain_id, chrom, start, end (from), to_chrom, to_start, to_end, to_size, strand. A region maps if just
    one chain covers it and the covered share reaches min_match; its ends go to the first and last base covered.
    """
    keys = regions.select("chrom", "start", "end").distinct()
    pairs = overlap_join(keys, blocks)
    a, b = F.greatest("q_start", "t_start"), F.least("q_end", "t_end")
    minus = F.col("t_strand") == "-"
    low = F.when(minus, F.col("t_to_end") - (b - F.col("t_start"))).otherwise(F.col("t_to_start") + (a - F.col("t_start")))
    high = F.when(minus, F.col("t_to_end") - (a - F.col("t_start"))).otherwise(F.col("t_to_start") + (b - F.col("t_start")))
    per = pairs.groupBy("q_chrom", "q_start", "q_end", "t_chain_id").agg(F.min("t_to_chrom").alias("to_chrom"), F.min(low).alias("to_start"), F.max(high).alias("to_end"), F.sum(b - a).alias("matched"))
    one = per.groupBy(F.col("q_chrom").alias("chrom"), F.col("q_start").alias("start"), F.col("q_end").alias("end")).agg(F.count("*").alias("chains"), *[F.min(c).alias(c) for c in ("to_chrom", "to_start", "to_end", "matched")])
    joined = regions.join(one, ["chrom", "start", "end"], "left")
    reason = F.when(F.col("chains").isNull(), "no chain").when(F.col("chains") > 1, "several chains").when(F.col("matched") < min_match * (F.col("end") - F.col("start")), "too few bases")
    marked = joined.withColumn("reason", reason)
    mapped = marked.where("reason is null").drop("reason", "chains", "matched")
    return mapped, marked.where("reason is not null").select(*regions.columns, "reason")


def filter_variants(variants: DataFrame, *tests: Column, biallelic_sites: bool = False, min_distance: int | None = None) -> DataFrame:
    """variants (chrom, pos, ref, alts, ...) that pass all tests.

    biallelic_sites: only sites (chrom, pos) that occur once in the whole table. min_distance: positions nearer
    than that to another variant go, both of them.
    """
    kept = variants
    for test in tests:
        kept = kept.where(test)
    if biallelic_sites:
        kept = kept.withColumn("__n", F.count("*").over(Window.partitionBy("chrom", "pos"))).where("__n = 1").drop("__n")
    if min_distance is not None:
        w = Window.partitionBy("chrom").orderBy("pos")
        near = F.least(F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(1 << 40)), F.coalesce(F.lead("pos").over(w) - F.col("pos"), F.lit(1 << 40)))
        kept = kept.withColumn("__d", near).where(F.col("__d") >= min_distance).drop("__d")
    return kept


def is_substitution(ref: Column, alts: Column) -> Column:
    """Reference and all alternatives are one base."""
    return (F.length(ref) == 1) & F.forall(alts, lambda a: F.length(a) == 1)


def weak_to_strong(ref: Column, alt: Column) -> Column:
    return ref.isin("A", "T") & alt.isin("C", "G")


def strong_to_weak(ref: Column, alt: Column) -> Column:
    return ref.isin("C", "G") & alt.isin("A", "T")


def is_segregating(genotypes: Column) -> Column:
    """Two different alleles occur; genotypes: array of allele arrays, missing alleles below 0."""
    return F.size(F.array_distinct(F.filter(F.flatten(genotypes), lambda a: a >= 0))) > 1


def allele_counts(variants: DataFrame) -> DataFrame:
    """chrom, pos, derived (alleles above 0) and total of the known alleles of all samples."""
    known = F.filter(F.flatten("genotypes"), lambda a: a >= 0)
    return variants.select("chrom", "pos", F.size(F.filter(known, lambda a: a > 0)).cast("long").alias("derived"), F.size(known).cast("long").alias("total"))


def substitution_counts(variants: DataFrame) -> DataFrame:
    """Substitutions by reference and first alternative."""
    first = F.get("alts", F.lit(0))
    return variants.select("ref", first.alias("alt")).where((F.length("ref") == 1) & (F.length("alt") == 1)).groupBy("ref", "alt").agg(F.count("*").alias("n"))


def read_blocks(reads: DataFrame) -> DataFrame:
    """Aligned runs of reads: read_id, chrom, start, end and read_start of each matched block.

    reads: read_id, chrom, pos (1-based), cigar. Offsets come from running sums over the code's parts.
    """
    ops = reads.select("read_id", "chrom", F.col("pos").cast("long").alias("pos"), F.posexplode(sequence.cigar_ops(F.col("cigar"))).alias("i", "c"))
    w = Window.partitionBy("read_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda kinds: F.coalesce(F.sum(F.when(F.col("c.op").isin(*kinds), F.col("c.run")).otherwise(0)).over(w), F.lit(0))
    placed = ops.withColumn("__r", before("MDN=X")).withColumn("read_start", before("MIS=X"))
    start = F.col("pos") - 1 + F.col("__r")
    return placed.where(F.col("c.op").isin(*"M=X")).select("read_id", "chrom", start.alias("start"), (start + F.col("c.run")).alias("end"), "read_start")


def pileup(reads: DataFrame, min_depth: int = 1) -> DataFrame:
    """Base counts at each reference position: chrom, pos (1-based), a, c, g, t, n, depth.

    reads: read_id, chrom, pos, cigar, seq. Reads are short, so a row for each aligned base is bounded by the
    input; counts are aggregated before the shuffle.
    """
    blocks = read_blocks(reads).join(reads.select("read_id", "seq"), "read_id")
    bases = blocks.select("chrom", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("start") - 1), lambda i: F.struct((F.col("start") + i + 1).alias("pos"), F.upper(F.substring(F.col("seq"), (F.col("read_start") + i + 1).cast("int"), F.lit(1))).alias("base")))).alias("x"))
    counts = [F.count(F.when(F.col("x.base") == b, 1)).alias(b.lower()) for b in "ACGTN"]
    return bases.groupBy("chrom", "x.pos").agg(*counts, F.count("*").alias("depth")).where(F.col("depth") >= min_depth)


def cell_gene_counts(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """Reads by cell and gene: reads (read_id, cell, chrom, start, end) inside just one gene (chrom, start, end, gene).

    No pairs are made. Genes are numbered; of the genes that a read meets, their count, the sum of their numbers and that of the squares
    tell whether all are one: only then is the square of the sum as much as the count times the sum of squares.
    """
    ids = genes.select("gene").where("gene is not null").distinct().withColumn("__id", F.row_number().over(Window.orderBy("gene")))  # one row a gene
    met = met_sums(reads.select("read_id", "cell", "chrom", "start", "end"), genes.join(ids, "gene", "left"), __any=F.lit(1), __k=F.when(F.col("__id").isNotNull(), 1), __s=F.col("__id"), __s2=F.col("__id").cast("decimal(10,0)") * F.col("__id").cast("decimal(10,0)"), wide=("__s2",))
    # A read of several genes has bounds that no gene has.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    single = wide("__k") * F.col("__s2") == wide("__s") * wide("__s")
    bound = lambda none: F.when(F.col("__k") > 0, F.when(single, F.expr("__s div __k")).otherwise(none))
    per = met.where("__any > 0").select("read_id", "cell", bound(0).alias("low"), bound(1 << 40).alias("high"))
    one = per.groupBy("read_id").agg(F.min("cell").alias("cell"), F.min("low").alias("__id"), F.max("high").alias("high")).where("__id = high")
    return one.groupBy("cell", "__id").agg(F.count("*").alias("reads")).join(ids, "__id").select("cell", "gene", "reads")


def distinct_sequences(df: DataFrame) -> DataFrame:
    """One row for each sequence with its names in byte order, joined by "; "."""
    return df.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


def digest(df: DataFrame, motif: str, cut: int) -> DataFrame:
    """Fragments of sequences (name, seq) between the cut places, cut bases into each motif, which is plain text: name, start, end."""
    found = occurrences(df, motif)
    w = Window.partitionBy("name", "__row").orderBy(F.coalesce("start", "size"))
    end = F.coalesce(F.col("start") + cut, F.col("size"))
    pieces = found.select("name", F.coalesce(F.lag(end).over(w), F.lit(0)).alias("start"), end.alias("end"))
    return pieces.where("end > start")


def window_divergence(aligned: DataFrame, window: int) -> DataFrame:
    """Differences of two aligned sequences in each window of reference bases: name, ref_start, differences.

    aligned: name, pos (column), a (reference base), b. A run of gaps on either side counts once. Sums come from
    a running total, so the cost does not grow with the window.
    """
    w = Window.partitionBy("name").orderBy("pos")
    gap_a, gap_b = F.col("a") == "-", F.col("b") == "-"
    opened = (gap_a & ~F.coalesce(F.lag("a").over(w) == "-", F.lit(False))) | (gap_b & ~F.coalesce(F.lag("b").over(w) == "-", F.lit(False)))
    marked = aligned.withColumn("d", F.when(gap_a | gap_b, opened.cast("int")).otherwise((F.upper("a") != F.upper("b")).cast("int")))
    total = marked.withColumn("t", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("a") != "-")
    per = total.withColumn("i", F.row_number().over(w) - 1).withColumn("before", F.lag("t", window).over(w)).withColumn("own", F.col("d"))
    full = per.where(F.col("i") >= window - 1)
    return full.select("name", (F.col("i") - window + 1).alias("ref_start"), (F.col("t") - F.coalesce("before", F.lit(0))).alias("differences"))
