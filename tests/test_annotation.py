"""Sequence look-up, products, transcripts, thinning, variant criteria, pairs against pairs, and written files."""

import random

import pytest
from pyspark.errors import PySparkException

from spanframe.operators import annotation, genomics, pairs
from spanframe.sources import text_formats, writers


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_lookup_joins_pieces_and_turns_strands(spark):
    seq = "".join(random.Random(3).choices("ACGT", k=57))
    sequences = spark.createDataFrame([("c", seq), ("n", None)], "name string, seq string")
    regions = spark.createDataFrame([("c", 0, 57, "+"), ("c", 3, 31, "-"), ("c", 3, 31, "-"), (None, 1, 2, "+")], "chrom string, start long, end long, strand string")
    turned = seq[3:31][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert rows(annotation.lookup_sequences(regions, sequences, piece=10), "seq") == sorted([(seq,), (turned,), (turned,), (None,)], key=str)
    for place in (("c", 50, 58, "+"), ("x", 0, 1, "+"), ("c", 4, 4, "+")):
        with pytest.raises(PySparkException):
            annotation.lookup_sequences(spark.createDataFrame([place], regions.schema), sequences, piece=10).collect()


def test_products_run_from_the_last_forward_site_to_the_next_reverse_site(spark):
    sequences = spark.createDataFrame([("s", "AACCGAACCTTTTGGTTAACC"), ("t", ""), ("u", None)], "name string, seq string")
    assert rows(annotation.amplicons(sequences, ["AACC"], None)) == [("s", 5, 17, "AACC+AACC")]
    assert rows(annotation.amplicons(sequences, ["AACC"], None, with_primers=False)) == [("s", 9, 13, "AACC+AACC")]
    assert rows(annotation.amplicons(sequences, ["AACC"], 11)) == []


def test_digest_takes_plain_text_and_keeps_rows_of_one_name_apart(spark):
    df = spark.createDataFrame([("a", "xx.y.zz"), ("a", "xx.y.zz"), ("b", "xyz"), ("c", "")], "name string, seq string")
    assert rows(genomics.digest(df, ".", 1)) == sorted([("a", 0, 3), ("a", 3, 5), ("a", 5, 7)] * 2 + [("b", 0, 3)], key=str)


def test_canonical_transcripts(spark):
    exons = spark.createDataFrame([("g", "t1", 0, 90, None, None), ("g", "t2", 0, 10, 2, 9), ("g", "t2", 20, 30, 20, 25), ("g", "t3", 0, 40, 0, 12), ("g", "t4", 0, 40, 0, 12), ("h", "t5", 0, 1, None, None)], "gene string, transcript string, start long, end long, cds_start long, cds_end long")
    assert rows(annotation.canonical_transcripts(exons)) == [("g", "t3", 12, 40), ("h", "t5", 0, 1)]


@pytest.mark.parametrize("tile", [1, 1 << 20])
def test_thinning_is_what_one_pass_in_the_drawn_order_gives(spark, tile):
    from pyspark.sql import functions as F

    made = random.Random(5)
    data = [(made.choice("ab"), made.choice((made.randrange(300), 77)), i) for i in range(200)] + [(None, 5, 900), ("a", None, 901)]
    df = spark.createDataFrame(data, "chrom string, pos long, id long")
    kept = [900, 901]
    done = {"a": [], "b": []}
    for r in df.where("chrom is not null and pos is not null").select("*", F.xxhash64(F.lit(4), "id").alias("draw")).orderBy("draw", "id").collect():
        if all(abs(r["pos"] - p) >= 9 for p in done[r["chrom"]]):
            done[r["chrom"]].append(r["pos"])
            kept.append(r["id"])
    assert rows(annotation.thin(df, 9, "id", seed=4, tile=tile), "id") == sorted(((k,) for k in kept), key=str)
    assert annotation.thin(df.limit(0), 9, "id").count() == 0


def test_variant_criteria(spark, tmp_path):
    path = tmp_path / "a.vcf"
    lines = ["##x", "c\t5\tv1\tA\tG\t50\tPASS\tDP=12;DB\tGT:DP\t0|1:3\t0|0:1", "c\t6\tv2\tA\tT,C\t.\tlow\tDP=3\tGT\t1|1\t1|1", "d\t7\tv3\tAT\tA\t20\t.\t.\tGT\t.|.\t0|1"]
    path.write_text("\n".join(lines) + "\n")
    v = text_formats.read_vcf(spark, str(path))

    def left(**criteria):
        return "".join(x[1] for (x,) in rows(genomics.filter_variants(v, *annotation.variant_tests(**criteria)), "id"))

    assert [left(**c) for c in ({"chrom": "c"}, {"min_qual": 20}, {"max_pos": 6, "min_pos": 6}, {"ref": "A", "alts": ["T", "C"]})] == ["12", "13", "2", "2"]
    assert [left(**c) for c in ({"biallelic": True}, {"substitutions": True}, {"segregating": True}, {"passed": True})] == ["13", "12", "13", "13"]
    assert [left(**c) for c in ({"weak_or_strong": "change"}, {"weak_or_strong": "same"}, {"infos": ["DP > 5"]}, {"infos": ["DB"]}, {"formats": ["DP"]})] == ["1", "23", "1", "1", "1"]
    assert rows(annotation.keep_samples(v, ["x", "y"], ["y"]), "samples") == sorted([(["0|0:1"],), (["1|1"],), (["0|1"],)], key=str)


def test_pairs_against_pairs(spark):
    schema = "id int, a struct<chrom:string,start:long,end:long>, b struct<chrom:string,start:long,end:long>"
    one = spark.createDataFrame([(1, ("c", 0, 5), ("c", 90, 95)), (2, ("c", 0, 5), ("d", 3, 4))], schema)
    two = spark.createDataFrame([(7, ("c", 92, 93), ("c", 4, 9)), (8, ("c", 1, 2), ("c", 2, 3)), (9, ("c", 0, 99), ("x", 0, 1))], schema)
    assert rows(pairs.pairs_meeting(one, two)) == [(1, 7), (1, 9)]


def test_written_files_read_back(spark, tmp_path):
    track = spark.createDataFrame([("c", p, p / 4) for p in (0, 1, 2, 5, 65535, 65536)] + [("d", 3, -1.5)], "chrom string, pos long, value double")
    writers.write_wig(track, str(tmp_path / "a.wig"))
    assert rows(text_formats.read(spark, str(tmp_path / "a.wig"))) == rows(track)
    reads = spark.createDataFrame([("r", "ACGT" * 30, "I" * 120)], "name string, seq string, qual string")
    writers.write_fastq(reads, str(tmp_path / "a.fq"), compression="gzip")
    assert rows(text_formats.read_fastq(spark, str(tmp_path / "a.fq"))) == rows(reads)
    writers.write_fasta(reads, str(tmp_path / "a.fa"), width=7)
    assert rows(text_formats.read_fasta(spark, str(tmp_path / "a.fa"))) == rows(reads.drop("qual"))
    with pytest.raises(PySparkException):
        writers.write_fasta(spark.createDataFrame([("r", None)], "name string, seq string"), str(tmp_path / "b.fa"))
