"""Alignment formats whose records are blocks of lines, separated by an empty line.

The empty line is the reader's line separator, so a block is one record and large files split between blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Column lines: the lines of each block that are not empty and no comments."""
    raw = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    return raw.select(lines.alias("lines")).where(F.size("lines") > 0)


def _words(line: Column) -> Column:
    return F.split(F.trim(line), "\\s+")


def read_axt(spark: SparkSession, path: str) -> DataFrame:
    """number, chrom, start, end (zero-based, half-open), q_chrom, q_start, q_end, strand, score, seq, q_seq."""
    rows = read_blocks(spark, path).where(F.size("lines") >= 3).select(_words(F.get("lines", F.lit(0))).alias("h"), F.get("lines", F.lit(1)).alias("seq"), F.get("lines", F.lit(2)).alias("q_seq"))
    at = lambda i: F.get("h", F.lit(i))
    return rows.select(at(0).cast("long").alias("number"), at(1).alias("chrom"), (at(2).cast("long") - 1).alias("start"), at(3).cast("long").alias("end"), at(4).alias("q_chrom"), (at(5).cast("long") - 1).alias("q_start"), at(6).cast("long").alias("q_end"), at(7).alias("strand"), at(8).cast("double").alias("score"), "seq", "q_seq")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ungapped block: chain_id, score, chrom, start, end, to_chrom, to_start, to_end, strand.

    Starts come from running sums of sizes and gaps over a chain's lines. On the minus strand the target
    coordinates are turned to the plus strand.
    """
    rows = read_blocks(spark, path).where(F.get("lines", F.lit(0)).startswith("chain"))
    h = _words(F.get("lines", F.lit(0)))
    at = lambda i: F.get("h", F.lit(i))
    body = F.transform(F.slice("lines", 2, F.size("lines")), _words)
    number = lambda parts, i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    flat = rows.select(h.alias("h"), F.posexplode(body).alias("i", "p")).select(at(12).cast("long").alias("chain_id"), at(1).cast("double").alias("score"), at(2).alias("chrom"), at(5).cast("long").alias("s"), at(7).alias("to_chrom"), at(8).cast("long").alias("to_size"), at(9).alias("strand"), at(10).cast("long").alias("ts"), "i", number("p", 0).alias("size"), number("p", 1).alias("dt"), number("p", 2).alias("dq"))
    w = Window.partitionBy("chain_id", "chrom", "s", "to_chrom", "ts").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumn("a", F.col("s") + F.coalesce(F.sum(F.col("size") + F.col("dt")).over(w), F.lit(0))).withColumn("b", F.col("ts") + F.coalesce(F.sum(F.col("size") + F.col("dq")).over(w), F.lit(0)))
    minus = F.col("strand") == "-"
    low = F.when(minus, F.col("to_size") - F.col("b") - F.col("size")).otherwise(F.col("b"))
    return placed.where("size > 0").select("chain_id", "score", "chrom", F.col("a").alias("start"), (F.col("a") + F.col("size")).alias("end"), "to_chrom", low.alias("to_start"), (low + F.col("size")).alias("to_end"), "to_size", "strand")


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sequence line: block score, src, chrom, start, size, strand, src_size, seq.

    block: a hash of the block's first sequence line, which its rows share.
    """
    rows = read_blocks(spark, path).where(F.get("lines", F.lit(0)).rlike("^a\\b"))
    score = F.regexp_extract(F.get("lines", F.lit(0)), "score=([-+0-9.eE]+)", 1).try_cast("double")
    seqs = F.filter("lines", lambda x: x.rlike("^s\\s"))
    flat = rows.select(score.alias("score"), F.xxhash64(F.get(seqs, F.lit(0))).alias("block"), F.explode(F.transform(seqs, _words)).alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    return flat.select("block", "score", F.split_part(at(1), F.lit("."), F.lit(1)).alias("species"), F.regexp_extract(at(1), "^[^.]*\\.(.*)$", 1).alias("chrom"), at(2).cast("long").alias("start"), at(3).cast("long").alias("size"), at(4).alias("strand"), at(5).cast("long").alias("src_size"), at(6).alias("seq"))


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """matches, strand, query and target name, size, start and end, and the arrays of blocks."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").rlike("^[0-9]+\t")).select(f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    longs = lambda i: F.transform(F.filter(F.split(at(i), ","), lambda x: x != ""), lambda x: x.cast("long"))
    return rows.select(at(0).cast("long").alias("matches"), at(8).alias("strand"), at(9).alias("q_name"), at(10).cast("long").alias("q_size"), at(11).cast("long").alias("q_start"), at(12).cast("long").alias("q_end"), at(13).alias("chrom"), at(14).cast("long").alias("size"), at(15).cast("long").alias("start"), at(16).cast("long").alias("end"), longs(18).alias("block_sizes"), longs(19).alias("q_starts"), longs(20).alias("t_starts"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an ontology: id, name, namespace, parents, obsolete."""
    rows = read_blocks(spark, path).where(F.get("lines", F.lit(0)) == "[Term]")
    one = lambda key: F.get(F.transform(F.filter("lines", lambda x: x.startswith(f"{key}: ")), lambda x: F.substring(x, F.lit(len(key) + 3), F.length(x))), F.lit(0))
    parents = F.transform(F.filter("lines", lambda x: x.startswith("is_a: ")), lambda x: F.regexp_extract(x, "^is_a: (\\S+)", 1))
    return rows.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), parents.alias("parents"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("obsolete"))
