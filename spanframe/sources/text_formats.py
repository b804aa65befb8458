"""Line formats as DataFrames: readers parse with column expressions, writers emit lines.

Hadoop's codecs read .gz and other suffixes. Coordinates become zero-based and half-open on reading and get
their format's base again on writing; missing marks (".", "*") become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """Column value: the lines that are not empty and do not begin with the comment mark."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    return lines.where(~F.col("value").startswith(comment)) if comment else lines


def _fields(separator: str = "\t") -> Column:
    return F.split("value", separator)


def _or_null(c: Column, mark: str = ".") -> Column:
    return F.when(c != mark, c)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand, annotation, n_fields."""
    f = _fields()
    rows = read_lines(spark, path).where(~F.col("value").rlike("^(track|browser)\\b")).select(f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(at(0).alias("chrom"), at(1).cast("long").alias("start"), at(2).cast("long").alias("end"), at(3).alias("name"), at(4).try_cast("int").alias("score"), _or_null(at(5)).alias("strand"), F.when(F.size("f") > 6, F.slice("f", 7, F.size("f"))).otherwise(F.array().cast("array<string>")).alias("annotation"), F.size("f").alias("n_fields"))


def write_bed(df: DataFrame, path: str, compression: str = "none") -> None:
    """As many of chrom, start, end, name, score, strand as df has, in this order."""
    columns = []
    for name in ("chrom", "start", "end", "name", "score", "strand"):
        if name not in df.columns:
            break
        columns.append(F.coalesce(F.col(name).cast("string"), F.lit("0" if name == "score" else ".")))
    df.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """Structs a and b (chrom, start, end, strand), name, score."""
    rows = read_lines(spark, path).select(_fields().alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    foot = lambda i, s: F.struct(at(i).alias("chrom"), at(i + 1).cast("long").alias("start"), at(i + 2).cast("long").alias("end"), _or_null(at(s)).alias("strand"))
    return rows.select(foot(0, 8).alias("a"), foot(3, 9).alias("b"), at(6).alias("name"), at(7).try_cast("double").alias("score"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    f = _fields()
    return read_lines(spark, path).where(~F.col("value").startswith("track")).select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].cast("double").alias("value"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (1-based), id, ref, alts, qual, filter, info, format, samples, genotypes; start and end zero-based.

    A reference of several bases begins with an anchor base that start leaves out. Missing alleles are -1.
    """
    rows = read_lines(spark, path).select(_fields().alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    pairs = F.transform(F.filter(F.split(at(7), ";"), lambda x: ~x.isin("", ".")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.when(x.contains("="), F.regexp_extract(x, "^[^=]*=(.*)$", 1)).otherwise(F.lit("")).alias("value")))
    info = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda k: F.struct(k, F.get(F.filter(pairs, lambda p: p["key"] == k), F.lit(0))["value"])))
    calls = F.transform("samples", lambda s: F.transform(F.regexp_extract_all(F.split_part(s, F.lit(":"), F.lit(1)), F.lit("[0-9]+|\\."), F.lit(0)), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1))))
    out = rows.select(at(0).alias("chrom"), at(1).cast("long").alias("pos"), _or_null(at(2)).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), at(5).try_cast("double").alias("qual"), _or_null(at(6)).alias("filter"), info.alias("info"), at(8).alias("format"), F.when(F.size("f") > 9, F.slice("f", 10, F.size("f"))).otherwise(F.array().cast("array<string>")).alias("samples"))
    start = F.col("pos") - F.when(F.length("ref") == 1, 1).otherwise(0)
    return out.withColumn("genotypes", calls).withColumn("start", start).withColumn("end", F.col("pos") - 1 + F.length("ref"))


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """kind (INFO, FORMAT, ...), id, number, type, description of the declarations."""
    lines = spark.read.text(path).where(F.col("value").rlike("^##[A-Z]+=<"))
    part = lambda key: F.regexp_extract("value", f'{key}=("([^"]*)"|[^,>]*)', 1)
    return lines.select(F.regexp_extract("value", "^##([A-Z]+)=", 1).alias("kind"), part("ID").alias("id"), part("Number").alias("number"), part("Type").alias("type"), F.replace(part("Description"), F.lit('"'), F.lit("")).alias("description"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fields, tags as a map of key:type to value, and the zero-based start and end on the reference."""
    from spanframe.functions.sequence import reference_length

    rows = read_lines(spark, path, "@").select(_fields().alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    tags = F.map_from_entries(F.transform(F.slice("f", 12, F.size("f")), lambda t: F.struct(F.substring(t, F.lit(1), F.lit(4)), F.substring(t, F.lit(6), F.length(t)))))
    out = rows.select(at(0).alias("qname"), at(1).cast("int").alias("flag"), _or_null(at(2), "*").alias("chrom"), at(3).cast("long").alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), _or_null(at(6), "*").alias("rnext"), at(7).cast("long").alias("pnext"), at(8).cast("long").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), F.when(F.size("f") > 11, tags).alias("tags"))
    return out.withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos") - 1 + reference_length(F.col("cigar")))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, source, feature, start, end (zero-based, half-open), score, strand, frame, attributes."""
    rows = read_lines(spark, path).select(_fields().alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    pairs = F.regexp_extract_all(at(8), F.lit('([A-Za-z_]+) "?([^";]*)"?;?'), F.lit(0))
    key = lambda p: F.regexp_extract(p, "^([A-Za-z_]+)", 1)
    value = lambda p: F.regexp_extract(p, '^[A-Za-z_]+ "?([^";]*)', 1)
    keys = F.array_distinct(F.transform(pairs, key))
    attributes = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(F.get(F.filter(pairs, lambda p: key(p) == k), F.lit(0))))))
    return rows.select(at(0).alias("chrom"), at(1).alias("source"), at(2).alias("feature"), (at(3).cast("long") - 1).alias("start"), at(4).cast("long").alias("end"), at(5).try_cast("double").alias("score"), _or_null(at(6)).alias("strand"), _or_null(at(7)).alias("frame"), attributes.alias("attributes"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of each record; records may span lines. A mark at a line's start separates records, one elsewhere is text."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.length("value") > 0)
    return raw.select(F.trim(F.split_part("value", F.lit("\n"), F.lit(1))).alias("name"), F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), "[\r\n]", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual of four-line records, found by the mark of the next name.

    A quality line that itself begins with that mark cannot be told from a name; it is an error, never a wrong
    record.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).where(F.length("value") > 0)
    f = F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), "\n+$", ""), "\n")
    whole = (F.size(f) == 4) & (F.length(F.get(f, F.lit(1))) == F.length(F.get(f, F.lit(3))))
    bad = F.raise_error(F.lit("a sequencing record does not have four lines")).cast("string")
    return raw.select(F.when(whole, f[0]).otherwise(bad).alias("name"), F.get(f, F.lit(1)).alias("seq"), F.get(f, F.lit(3)).alias("qual"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    f = _fields("\\s+")
    return read_lines(spark, path).select(f[0].alias("chrom"), f[1].cast("long").alias("size"))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Gene annotations: gene, symbol, qualifier, term, evidence, aspect."""
    f = _fields()
    return read_lines(spark, path, "!").select(f[1].alias("gene"), f[2].alias("symbol"), f[3].alias("qualifier"), f[4].alias("term"), f[6].alias("evidence"), f[8].alias("aspect"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    f = _fields("\\s+")
    return read_lines(spark, path).select(f[0].cast("long").alias("bin1"), f[1].cast("long").alias("bin2"), f[2].cast("double").alias("score"))


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """A fixed-step track as chrom, pos (zero-based), value; each file is parsed as a whole by its stretches.

    The header mark is the line separator, so a stretch is one record and large files split between stretches.
    Lines that belong to no fixedStep stretch, as those of a variableStep one, are an error.
    """
    raw = spark.read.option("lineSep", "fixedStep ").text(path)
    stretch = F.col("value").startswith("chrom=")
    lines = F.split(F.when(stretch, F.regexp_replace("value", "^[^\n]*", "")).otherwise(F.col("value")), "\n")
    aside = lambda x: x.rlike(r"^(\s*$|#|track\b|browser\b)")
    strange = F.exists(lines, lambda x: ~aside(x) & ~(stretch & x.rlike(r"^[-+0-9.]\S*\s*$")))
    bad = F.raise_error(F.lit("a WIG file holds lines outside fixedStep stretches; convert variableStep before reading")).cast("boolean")
    raw = raw.where(F.when(strange, bad).otherwise(stretch))
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    number = lambda key, default: F.coalesce(F.regexp_extract(head, f"{key}=([0-9]+)", 1).try_cast("long"), F.lit(default))
    body = F.filter(F.split(F.regexp_replace("value", "^[^\n]*\n?", ""), "\n"), lambda x: x.rlike("^[-+0-9.]"))
    rows = raw.select(F.regexp_extract(head, "chrom=(\\S+)", 1).alias("chrom"), number("start", 1).alias("s"), number("step", 1).alias("step"), F.posexplode(body).alias("i", "x"))
    return rows.select("chrom", (F.col("s") - 1 + F.col("i") * F.col("step")).alias("pos"), F.col("x").cast("double").alias("value"))


READERS = {"bed": read_bed, "bedpe": read_bedpe, "bedgraph": read_bedgraph, "vcf": read_vcf, "sam": read_sam, "gtf": read_gtf, "fa": read_fasta, "fasta": read_fasta, "fastq": read_fastq, "fq": read_fastq, "wig": read_wig, "gaf": read_gaf, "sizes": read_chrom_sizes, "straw": read_contacts}


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the path's extension, a compression suffix apart."""
    plain = path[:-3] if path.endswith(".gz") else path
    kind = plain.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}")
    return READERS[kind](spark, path)
