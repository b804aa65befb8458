"""Small cases of the other operators, each with a hand-made answer."""

import math
import random
import pytest
from pyspark.sql import functions as F

from spanframe.functions import numbers as nb
from spanframe.functions import sequence as sq
from spanframe.operators import coverage, genomics, islands, regions, statistics
from spanframe.sources import text_formats as tf


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


@pytest.fixture(scope="module")
def beds(spark):
    return spark.createDataFrame([("a", 0, 10, 1, "+"), ("a", 2, 4, 7, "-"), ("a", 10, 12, 2, "+"), ("a", 20, 21, 5, "-"), ("b", 5, 6, 1, "+")], "chrom string, start long, end long, score int, strand string")


def test_merge(beds):
    assert rows(islands.merge_intervals(beds, F.max("score").alias("m")), "chrom", "start", "end", "m") == [("a", 0, 10, 7), ("a", 10, 12, 2), ("a", 20, 21, 5), ("b", 5, 6, 1)]
    assert rows(islands.merge_intervals(beds, pad=1), "chrom", "start", "end") == [("a", 0, 12), ("a", 20, 21), ("b", 5, 6)]


def test_invert(spark, beds):
    sizes = spark.createDataFrame([("a", 25), ("c", 3)], "chrom string, size long")
    assert rows(islands.invert(beds.where("chrom = 'a'"), sizes)) == [("a", 12, 20), ("a", 21, 25), ("c", 0, 3)]


def test_coverage(beds):
    assert rows(coverage.coverage_segments(beds.where("chrom = 'a'"))) == [("a", 0, 2, 1), ("a", 2, 4, 2), ("a", 4, 10, 1), ("a", 10, 12, 1), ("a", 20, 21, 1)]
    assert rows(coverage.depth_histogram(beds)) == [(1, 12), (2, 2)]


def test_sliding_coverage(spark, beds):
    sizes = spark.createDataFrame([("a", 25)], "chrom string, size long")
    depth = [0] * 25
    for c, s, e, *_ in beds.collect():
        if c == "a":
            for i in range(s, e):
                depth[i] += 1
    got = rows(coverage.sliding_coverage(beds.where("chrom = 'a'"), sizes, 4))
    assert got and all(v == sum(depth[x : x + 4]) for _, x, v in got)


def test_smooth_and_peaks(spark):
    t = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 10, 11, 0])] + [("a", 9, 4.0)], "chrom string, pos long, value double")
    assert rows(coverage.smooth(t, 3)) == [("a", 1, 2.0), ("a", 2, 5.0), ("a", 3, 8.0), ("a", 4, 7.0)]
    assert rows(islands.peaks(t, 3.0)) == [("a", 2, 5, 11), ("a", 9, 10, 4)]


def test_regions(beds):
    assert rows(regions.tss(beds), "chrom", "start", "end") == [("a", 0, 1), ("a", 3, 4), ("a", 10, 11), ("a", 20, 21), ("b", 5, 6)]
    assert rows(regions.shear(beds.where("start = 0"), 4), "start", "end", "piece") == [(0, 4, 0), (4, 8, 1), (8, 10, 2)]
    assert rows(regions.filter_regions(beds, min_score=5), "score") == [(5,), (7,)]
    assert rows(regions.trim(beds.where("start = 0"), 2, 3), "start", "end") == [(2, 7)]


def test_n50(spark):
    got = statistics.assembly_stats(spark.createDataFrame([(x,) for x in (80, 70, 50, 40, 30, 20)], "length long")).first()
    assert tuple(got) == (290, 6, 80, 70, 2)


def test_numbers():
    assert nb.binomial_right_tail(10, 8, 0.5) == pytest.approx(56 / 1024)
    assert nb.fisher_exact(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert nb.poisson_binomial_right_tail([0.5, 0.5], 1) == pytest.approx(0.75)
    assert nb.integrate(lambda x: x * x, 0, 3) == pytest.approx(9)
    assert nb.golden_section_max(lambda x: -((x - 2) ** 2), 0, 5) == pytest.approx(2, abs=1e-5)
    assert nb.log_add(0.0, 0.0) == pytest.approx(0.693147, abs=1e-6)


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN-ac", "ATGTAAx", "3S10M2D5M1I")], "s string, c string, g string")
    got = df.select(sq.reverse_complement(F.col("s")), sq.translate_codons(F.col("c")), sq.reference_length(F.col("g")), sq.query_length(F.col("g")), sq.hamming(F.lit("ACGT"), F.lit("AGGA"))).first()
    assert tuple(got) == ("gt-NACGT", "M*", 17, 19, 2)


def test_pileup(spark):
    reads = spark.createDataFrame([(1, "a", 3, "2M1I2M", "ACTGG"), (2, "a", 4, "1S2M", "TCG")], "read_id int, chrom string, pos long, cigar string, seq string")
    got = {r["pos"]: (r["a"], r["c"], r["g"], r["depth"]) for r in genomics.pileup(reads).collect()}
    assert got == {3: (1, 0, 0, 1), 4: (0, 2, 0, 2), 5: (0, 0, 2, 2), 6: (0, 0, 1, 1)}


def test_lift(spark):
    blocks = spark.createDataFrame([(1, "a", 0, 100, "x", 1000, 1100, "+"), (2, "a", 200, 300, "y", 0, 100, "-"), (3, "a", 250, 300, "z", 0, 50, "+")], "chain_id int, chrom string, start long, end long, to_chrom string, to_start long, to_end long, strand string")
    beds = spark.createDataFrame([("a", 10, 20), ("a", 210, 220), ("a", 260, 270), ("a", 150, 160), ("a", 95, 105)], "chrom string, start long, end long")
    mapped, lost = genomics.lift(beds, blocks)
    assert rows(mapped, "start", "to_chrom", "to_start", "to_end") == [(10, "x", 1010, 1020), (210, "y", 80, 90)]
    assert rows(lost, "start", "reason") == [(95, "too few bases"), (150, "no chain"), (260, "several chains")]


def test_formats(spark, tmp_path):
    def made(name, text):
        (tmp_path / name).write_text(text)
        return tf.read(spark, str(tmp_path / name))

    assert rows(made("x.bed", "#c\nchr1\t1\t5\tn\t3\t+\tq\nchr1\t2\t4\n"), "chrom", "start", "end", "score", "strand", "n_fields") == [("chr1", 1, 5, 3, "+", 7), ("chr1", 2, 4, None, None, 3)]
    v = made("x.vcf", "##fileformat=VCFv4.2\n#CHROM\nc\t5\t.\tA\tG,T\t.\tPASS\tDP=3;X\tGT\t0/1\t./.\nc\t5\t.\tAT\tA\t9\t.\t.\tGT\t1|1\t0\n").collect()
    assert [(r["start"], r["end"], r["qual"], r["genotypes"]) for r in v] == [(4, 5, None, [[0, 1], [-1, -1]]), (5, 6, 9.0, [[1, 1], [0]])] and v[0]["info"] == {"DP": "3", "X": ""}
    assert rows(made("x.fa", ">a b\nACG\nT\n>c\nNN\n")) == [("a b", "ACGT"), ("c", "NN")]
    assert rows(made("x.fastq", "@r1\nAC\n+\nII\n@r2\nG\n+\n#\n")) == [("r1", "AC", "II"), ("r2", "G", "#")]
    assert rows(made("x.wig", "fixedStep chrom=c start=3 step=2\n1\n2.5\nfixedStep chrom=d start=1\n7\n")) == [("c", 2, 1.0), ("c", 4, 2.5), ("d", 0, 7.0)]
    s = made("x.sam", "@HD\nr\t0\tc\t3\t60\t2M1D1M\t*\t0\t0\tACG\tIII\tNM:i:1\n").first()
    assert (s["start"], s["end"], s["tags"]) == (2, 6, {"NM:i": "1"})
    g = made("x.gtf", 'c\ts\texon\t3\t9\t.\t-\t.\tgene_id "G1"; n "2";\n').first()
    assert (g["start"], g["end"], g["strand"], g["attributes"]) == (2, 9, "-", {"gene_id": "G1", "n": "2"})


def test_wig_stretches_of_other_kinds_are_errors(spark, tmp_path):
    fixed, variable = "fixedStep chrom=c start=3 step=2\n1\n2.5\n", "variableStep chrom=c\n10 1.5\n"
    for k, text in enumerate((variable, variable + fixed, fixed + variable, "7\n" + fixed)):
        (tmp_path / f"{k}.wig").write_text(text)
        with pytest.raises(Exception, match="variableStep|fixedStep"):
            tf.read(spark, str(tmp_path / f"{k}.wig")).collect()
    (tmp_path / "x.wig").write_text("track type=wiggle_0\n# note\n\n" + fixed + "\n")
    assert rows(tf.read(spark, str(tmp_path / "x.wig"))) == [("c", 2, 1.0), ("c", 4, 2.5)]


def test_marks_inside_a_name_do_not_split_it(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a x>y\nAC\nGT\n>b\nN\n")
    assert rows(tf.read(spark, str(tmp_path / "x.fa"))) == [("a x>y", "ACGT"), ("b", "N")]


def test_running_totals_over_many_ranges(spark):
    r = random.Random(8)
    values = [round(r.expovariate(0.7), 2) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, value double").repartition(6)
    got = {x["id"]: x["fdr"] for x in regions.fdr_by_rank(df).collect()}
    for i, v in enumerate(values):
        assert got[i] == pytest.approx(max(0.0, v - math.log10(len(values) / sum(w >= v for w in values))))
    p = [min(1.0, abs(v) / 5) for v in values]
    q = {x["id"]: x["q"] for x in statistics.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id int, p double")).collect()}
    rank = {x: sum(y <= x for y in p) for x in p}
    for i, x in enumerate(p):
        assert q[i] == pytest.approx(min(1.0, min(y * len(p) / rank[y] for y in p if y >= x)))
