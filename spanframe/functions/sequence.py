"""Column functions on sequences (strings of bases, case kept as a mask) and on alignment codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each base and its complement, both cases.
BASES, COMPLEMENTS = "ACGTacgtNn-", "TGCAtgcaNn-"
#: The standard genetic code, codons in the order T, C, A, G for each place.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def remove_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def count_base(seq: Column, base: str) -> Column:
    """Occurrences of a base in either case."""
    return F.regexp_count(seq, F.lit(f"[{base.upper()}{base.lower()}]"))


def gc_content(seq: Column) -> Column:
    """Share of G and C among A, C, G and T; null where there are none."""
    gc = F.regexp_count(seq, F.lit("[GCgc]"))
    return F.try_divide(gc.cast("double"), F.regexp_count(seq, F.lit("[ACGTacgt]")))


def masked_count(seq: Column) -> Column:
    """Lower-case bases."""
    return F.regexp_count(seq, F.lit("[acgtn]"))


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Half-open, zero-based."""
    return F.substring(seq, start + 1, end - start)


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, up to the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def codon_table() -> dict[str, str]:
    order = "TCAG"
    return {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}


def translate_codons(seq: Column) -> Column:
    """One-letter amino acids of whole codons; X for a codon with another letter than A, C, G and T."""
    table = F.create_map(*[F.lit(x) for pair in codon_table().items() for x in pair])
    codons = F.regexp_extract_all(F.upper(seq), F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(table[c], F.lit("X"))), "")


def cigar_ops(cigar: Column) -> Column:
    """array of (run, op) of an alignment code; empty for ``*``."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0)), lambda c: F.struct(F.regexp_extract(c, "^([0-9]+)", 1).cast("long").alias("run"), F.right(c, F.lit(1)).alias("op")))


def _runs(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.filter(cigar_ops(cigar), lambda c: c["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, c: a + c["run"])


def reference_length(cigar: Column) -> Column:
    """Reference positions that an alignment spans."""
    return _runs(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    """Bases of the read that an alignment accounts for."""
    return _runs(cigar, "MIS=X")


def matched_length(cigar: Column) -> Column:
    return _runs(cigar, "M=X")


def kmers(seq: Column, k: int) -> Column:
    """Array of (pos, kmer)."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def base_composition(seq: Column) -> Column:
    """Struct of counts a, c, g, t, n, gap in either case."""
    return F.struct(*[count_base(seq, b).alias(b.lower()) for b in "ACGTN"], F.regexp_count(seq, F.lit("-")).alias("gap"))
