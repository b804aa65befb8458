"""Sequences by region, cut places and products, transcripts, thinned positions and tests of variants."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.sequence import BASES, COMPLEMENTS, reverse_complement
from spanframe.scratch import Scratch

PIECE = 1 << 16


def lookup_sequences(regions: DataFrame, sequences: DataFrame, piece: int = PIECE) -> DataFrame:
    """regions (chrom, start, end, and strand if it is there) with seq, their bases; those on the minus strand are reversed.

    Sequences (name, seq) are cut into pieces, and a region meets only the pieces that it touches, so a long sequence is
    spread over tasks and no region ships it whole. A region of an unknown sequence, one that reaches beyond its end and
    one of no length are errors. Null coordinates give a null seq.
    """
    cut = sequences.where("seq is not null").select(F.col("name").alias("__name"), F.length("seq").alias("__size"), "seq", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(length(seq) - 1, 0) div {piece}"))).alias("__piece"))
    cut = cut.select("__name", "__size", "__piece", F.substring(F.col("seq"), F.col("__piece") * piece + 1, F.lit(piece)).alias("__bases"))
    keys = regions.where("chrom is not null and start is not null and end is not null").select("chrom", "start", "end").distinct()
    checked = F.when(F.col("end") > F.col("start"), F.expr(f"(end - 1) div {piece}")).otherwise(F.raise_error(F.lit("a region has no length")).cast("long"))
    touched = keys.withColumn("__piece", F.explode(F.sequence(F.expr(f"cast(start div {piece} as int)"), checked.cast("int"))))
    met = touched.join(cut, (F.col("chrom") == F.col("__name")) & (touched["__piece"] == cut["__piece"]), "left").select("chrom", "start", "end", touched["__piece"].alias("__piece"), "__size", "__bases")
    inside = F.coalesce((F.col("start") >= 0) & (F.col("end") <= F.col("__size")), F.lit(False))
    first = F.greatest(F.lit(0), F.col("start") - F.col("__piece") * piece)
    part = F.substring(F.col("__bases"), (first + 1).cast("int"), (F.least(F.lit(piece), F.col("end") - F.col("__piece") * piece) - first).cast("int"))
    bad = F.raise_error(F.concat_ws(" ", F.lit("no such place in the sequences:"), "chrom", "start", "end")).cast("string")
    parts = met.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct("__piece", F.when(inside, part).otherwise(bad).alias("bases")))).alias("__parts"))
    found = parts.select("chrom", "start", "end", F.array_join(F.col("__parts.bases"), "").alias("__seq"))
    seq = F.when(F.col("strand") == "-", reverse_complement(F.col("__seq"))).otherwise(F.col("__seq")) if "strand" in regions.columns else F.col("__seq")
    return regions.join(found, ["chrom", "start", "end"], "left").select(*[regions[c] for c in regions.columns], seq.alias("seq"))


def occurrences(sequences: DataFrame, motif: str) -> DataFrame:
    """Places of a motif, taken as plain text, from the left without overlaps: name, __row, start and size.

    Each place is a row with its start. Each sequence that is not null also has one row with size, its length, and no start;
    ``__row`` tells sequences of one name apart.
    """
    parts = sequences.where("seq is not null").withColumn("__row", F.monotonically_increasing_id()).select("name", "__row", F.posexplode(F.split("seq", r"\Q" + motif + r"\E")).alias("__i", "__part"))
    w = Window.partitionBy("name", "__row").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.length("__part")).over(w) + F.col("__i") * len(motif)
    last = F.lead("__i").over(Window.partitionBy("name", "__row").orderBy("__i")).isNull()
    return parts.select("name", "__row", F.when(~last, ends).alias("start"), F.when(last, ends).alias("size"))


def amplicons(sequences: DataFrame, primers: list[str], longest: int | None = 1000, with_primers: bool = True) -> DataFrame:
    """Products of primers on sequences (name, seq): chrom, start, end, name (forward primer + reverse primer).

    A product runs from a forward site to the reverse site that comes next, where no other forward site lies between. One
    window over all sites of a sequence in order finds them, without a join. Of sites at one place the least primer counts
    for reverse ones, the largest for forward ones. Empty primers are an error.
    """
    if not all(primers):
        raise ValueError("a primer is empty")
    turn = str.maketrans(BASES, COMPLEMENTS)
    sites = []
    for p in sorted({*primers}):
        ahead = occurrences(sequences, p).where("start is not null")
        back = occurrences(sequences, p.translate(turn)[::-1]).where("start is not null")
        sites += [ahead.select("name", (F.col("start") + len(p)).alias("at"), F.lit(1).alias("forward"), F.lit(p).alias("primer")), back.select("name", F.col("start").alias("at"), F.lit(0), F.lit(p))]
    w = Window.partitionBy("name").orderBy("at", "forward", "primer")
    following = F.lead(F.struct("at", "forward", "primer")).over(w)
    found = reduce(DataFrame.union, sites).withColumn("next", following).where("forward = 1 and next.forward = 0")
    around = with_primers * 1
    out = found.select(F.col("name").alias("chrom"), (F.col("at") - around * F.length("primer")).alias("start"), (F.col("next.at") + around * F.length("next.primer")).alias("end"), F.concat_ws("+", "primer", "next.primer").alias("name"))
    return out if longest is None else out.where(F.col("end") - F.col("start") <= longest)


def canonical_transcripts(exons: DataFrame) -> DataFrame:
    """By gene its transcript with the longest coding sequence, then the longest exons, then the least name.

    exons: gene, transcript, start, end, cds_start, cds_end (null where an exon codes nothing). Result: gene, transcript,
    cds_length, cdna_length. Lengths are summed before the shuffle by gene.
    """
    lengths = exons.groupBy("gene", "transcript").agg(F.coalesce(F.sum(F.col("cds_end") - F.col("cds_start")), F.lit(0)).alias("cds_length"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("cdna_length"))
    best = F.min(F.struct((-F.col("cds_length")).alias("a"), (-F.col("cdna_length")).alias("b"), "transcript", "cds_length", "cdna_length"))
    return lengths.groupBy("gene").agg(best.alias("x")).select("gene", "x.transcript", "x.cds_length", "x.cdna_length")


def thin(df: DataFrame, distance: int, key: str, seed: int = 1, tile: int = 1 << 20) -> DataFrame:
    """Rows (chrom, pos, key) drawn in a random order, each kept if no row kept before it is nearer than distance.

    key names a row. In each round the undecided rows that come first among all within the distance are kept and those near
    them go, which gives what one pass in order gives, in a number of rounds that grows with the logarithm of the rows.
    Positions are dealt by tiles with their borders, so a chromosome is many tasks; of rows at one position only the first
    takes part. Rounds are written. Rows without chrom or pos are near nothing and kept.
    """
    if distance < 1:
        return df
    scratch, tile = Scratch(df.sparkSession, "thin"), max(tile, distance)
    near = Window.partitionBy("chrom", "tile").orderBy("pos").rangeBetween(1 - distance, distance - 1)

    def around(value: Column) -> Column:
        return F.min(value).over(near)

    def tiled(x: DataFrame) -> DataFrame:
        own = F.floor(F.col("pos") / tile)
        return x.withColumn("own", own).withColumn("tile", F.explode(F.array_distinct(F.array("own", F.floor((F.col("pos") - distance + 1) / tile), F.floor((F.col("pos") + distance - 1) / tile)))))

    draw = F.struct(F.xxhash64(F.lit(seed), key).alias("draw"), F.col(key).alias("key"))
    left = scratch.keep(df.where("chrom is not null and pos is not null").groupBy("chrom", F.col("pos").cast("long").alias("pos")).agg(F.min(draw).alias("draw")), "left-0")
    kept, at = [], 0
    while not left.isEmpty():
        first = tiled(left).withColumn("first", F.col("draw") == around(F.col("draw"))).where("tile = own").drop("own", "tile")
        first = scratch.keep(first, f"first-{at}")
        kept.append(first.where("first").select("draw.key"))
        beside = tiled(first).withColumn("beside", around(F.when(F.col("first"), 1))).where("tile = own and beside is null")
        at += 1
        left = scratch.keep(beside.select("chrom", "pos", "draw"), f"left-{at}")
    free = df.where("chrom is null or pos is null")
    if not kept:
        return free
    keys = reduce(DataFrame.union, kept).withColumnRenamed("key", "__key")
    return df.join(keys, (F.col(key) == F.col("__key")) & F.col("chrom").isNotNull() & F.col("pos").isNotNull(), "left_semi").union(free)


def variant_tests(*, chrom: str | None = None, min_pos: int | None = None, max_pos: int | None = None, min_qual: float | None = None, ref: str | None = None, alts: list[str] | None = None, biallelic: bool = False, substitutions: bool = False, segregating: bool = False, passed: bool = False, weak_or_strong: str | None = None, infos: list[str] = (), formats: list[str] = ()) -> list[Column]:
    """Tests for ``filter_variants`` from plain criteria; a missing value fails a bound on it.

    alts: all of a row's alternatives must be these, in this order. biallelic: one alternative. passed: the filter says PASS
    or nothing. weak_or_strong: "change" keeps substitutions between A or T and C or G, "same" the rest. infos: comparisons
    such as ``DP >= 10`` on info fields, or a bare key that must be there; formats: keys that the format column must name.
    """
    col, first = F.col, F.get("alts", F.lit(0))
    tests = [col("chrom") == chrom] if chrom is not None else []
    for name, low, high in (("pos", min_pos, max_pos), ("qual", min_qual, None)):
        tests += [col(name) >= low] if low is not None else []
        tests += [col(name) <= high] if high is not None else []
    tests += [col("ref") == ref] if ref is not None else []
    tests += [col("alts") == F.array(*[F.lit(a) for a in alts])] if alts is not None else []
    tests += [F.size("alts") == 1] if biallelic else []
    tests += [(F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1)] if substitutions else []
    if segregating:
        tests.append(F.size(F.array_distinct(F.filter(F.flatten("genotypes"), lambda a: a >= 0))) > 1)
    tests += [col("filter").isNull() | (col("filter") == "PASS")] if passed else []
    if weak_or_strong is not None:
        weak, strong = ("A", "T"), ("C", "G")
        change = reduce(or_, [col("ref").isin(*x) & first.isin(*y) for x, y in ((weak, strong), (strong, weak))])
        tests.append({"change": change, "same": ~change}[weak_or_strong])
    for text in infos:
        words = text.split()
        value = F.try_element_at("info", F.lit(words[0]))
        if len(words) == 1:
            tests.append(value.isNotNull())
            continue
        key, how, bound = words
        try:
            left, right = value.try_cast("double"), F.lit(float(bound))
        except ValueError:
            left, right = value, F.lit(bound)
        tests.append({"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[how])
    tests += [F.array_contains(F.split("format", ":"), key) for key in formats]
    return tests


def keep_samples(variants: DataFrame, header: list[str], groups: list[str]) -> DataFrame:
    """variants with the samples and genotypes of those named in groups only, in the header's order."""
    at = [i for i, name in enumerate(header) if name in set(groups)]
    pick = lambda c: F.array(*[F.get(c, F.lit(i)) for i in at]) if at else F.slice(c, 1, 0)
    return variants.withColumns({"samples": pick("samples"), "genotypes": pick("genotypes")})
