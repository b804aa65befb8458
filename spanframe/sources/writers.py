"""Writers of line formats: the counterparts of the readers, in as many files as the frame has partitions.

A header goes into a file of its own in the same folder, which the readers skip as they skip comments; a reader outside
Spark should be given that file first. Coordinates get the format's own base again, and nulls the format's mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(df: DataFrame, line: Column, path: str, compression: str, header: list[str] = ()) -> None:
    """Any null in a line is an error, for half a line must not be written."""
    whole = F.when(line.isNotNull(), line).otherwise(F.raise_error(F.lit("a row lacks a value that the format needs")).cast("string"))
    mode = "overwrite"
    if header:
        df.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1).write.mode(mode).option("compression", compression).text(path)
        mode = "append"
    df.select(whole.alias("value")).write.mode(mode).option("compression", compression).text(path)


def _or(name: str | Column, mark: str = ".") -> Column:
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("string"), F.lit(mark))


def _line(*cells: Column, separator: str = "\t") -> Column:
    out = cells[0].cast("string")
    for c in cells[1:]:
        out = F.concat(out, F.lit(separator), c.cast("string"))
    return out


def write_bedgraph(df: DataFrame, path: str, compression: str = "none") -> None:
    """chrom, start, end, value."""
    _text(df, _line(*[F.col(c) for c in ("chrom", "start", "end", "value")]), path, compression)


def write_bedpe(df: DataFrame, path: str, compression: str = "none") -> None:
    """Structs a and b, and name and score, as ``read_bedpe`` gives them."""
    feet = [F.col(f"{side}.{c}") for side in "ab" for c in ("chrom", "start", "end")]
    _text(df, _line(*feet, _or("name"), _or("score"), _or("a.strand"), _or("b.strand")), path, compression)


def write_vcf(df: DataFrame, path: str, samples: list[str] = (), header: list[str] = (), compression: str = "none") -> None:
    """The columns that ``read_vcf`` gives; samples are the names of the sample columns, header further ## lines."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda x: F.when(x["value"] == "", x["key"]).otherwise(F.concat(x["key"], F.lit("="), x["value"]))), ";")
    cells = [F.col("chrom"), F.col("pos"), _or("id"), F.col("ref"), F.array_join("alts", ","), _or("qual"), _or("filter"), F.coalesce(F.when(info != "", info), F.lit("."))]
    cells += [_or("format"), *[F.get("samples", F.lit(i)) for i in range(len(samples))]] if samples else []
    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    _text(df, _line(*cells), path, compression, ["##fileformat=VCFv4.2", *header, "\t".join(names)])


def write_sam(df: DataFrame, path: str, header: list[str] = (), compression: str = "none") -> None:
    """The columns that ``read_sam`` gives; tags in the order of their keys."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat(F.lit("\t"), x["key"], F.lit(":"), x["value"])), "")
    cells = _line(F.col("qname"), F.col("flag"), _or("chrom", "*"), F.col("pos"), F.col("mapq"), F.col("cigar"), _or("rnext", "*"), F.col("pnext"), F.col("tlen"), F.col("seq"), F.col("qual"))
    _text(df, F.concat(cells, F.coalesce(tags, F.lit(""))), path, compression, list(header))


def write_fasta(df: DataFrame, path: str, width: int = 50, compression: str = "none") -> None:
    """name, seq; sequences are broken into lines of width bases."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    _text(df, F.concat(F.lit(">"), "name", F.lit("\n"), wrapped), path, compression)


def write_fastq(df: DataFrame, path: str, compression: str = "none") -> None:
    """name, seq, qual."""
    _text(df, F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual"), path, compression)


def write_wig(track: DataFrame, path: str, compression: str = "none") -> None:
    """A track (chrom, pos, value) as fixedStep stretches of step 1, one for each run of consecutive positions."""
    from spanframe.operators.coverage import runs_of

    runs = runs_of(track).groupBy("chrom", "run").agg(F.min("pos").alias("s"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    values = F.array_join(F.transform("x", lambda p: p["value"].cast("string")), "\n")
    _text(runs, F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(" start="), (F.col("s") + 1).cast("string"), F.lit(" step=1\n"), values), path, compression)
