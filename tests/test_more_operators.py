"""Block formats, pairs, motifs, alignment and simulation."""

import random

from spanframe.operators import pairs, simulate
from spanframe.operators.alignment import GAP_EXTEND, GAP_OPEN, MATCH, MISMATCH, align
from spanframe.sources import block_formats as bf


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_block_formats(spark, tmp_path):
    def path(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    axt = bf.read_axt(spark, path("a.axt", "#c\n0 c 3 6 d 1 4 + 9\nACGT\nAC-T\n\n1 c 9 9 d 5 5 - 1\nA\nA\n\n")).collect()
    assert [(r["start"], r["end"], r["q_start"], r["strand"], r["q_seq"]) for r in axt] == [(2, 6, 0, "+", "AC-T"), (8, 9, 4, "-", "A")]
    chain = bf.read_chain(spark, path("a.chain", "chain 10 c 100 + 10 30 d 50 - 5 27 7\n5 3 1\n4 0 4\n8\n\n"))
    assert rows(chain, "start", "end", "to_start", "to_end") == [(10, 15, 40, 45), (18, 22, 35, 39), (22, 30, 23, 31)]
    maf = bf.read_maf(spark, path("a.maf", "##maf\na score=5\ns hs.c1 3 2 + 9 AC\ns mm.c2 0 2 - 9 AG\n\n"))
    assert rows(maf, "species", "chrom", "start", "strand", "seq") == [("hs", "c1", 3, "+", "AC"), ("mm", "c2", 0, "-", "AG")]
    obo = bf.read_obo(spark, path("a.obo", "format: 1\n\n[Term]\nid: T1\nname: top\n\n[Term]\nid: T2\nname: low\nis_a: T1 ! top\nis_obsolete: true\n\n"))
    assert rows(obo, "id", "name", "parents", "obsolete") == [("T1", "top", [], False), ("T2", "low", ["T1"], True)]


def test_pairs(spark):
    schema = "id int, a struct<chrom:string,start:long,end:long>, b struct<chrom:string,start:long,end:long>"
    p = spark.createDataFrame([(1, ("c", 0, 5), ("c", 90, 95)), (2, ("c", 1, 2), ("c", 3, 4)), (3, ("d", 0, 9), ("c", 50, 60))], schema)
    r = spark.createDataFrame([("c", 0, 10)], "chrom string, start long, end long")
    assert rows(pairs.pairs_hit(p, r), "id") == [(1,), (2,)] and rows(pairs.pairs_hit(p, r, both=True), "id") == [(2,)]
    assert rows(pairs.contacts_of(p, r)) == [("c", 1, 2), ("c", 3, 4), ("c", 90, 95)]


def test_both_feet_meet_one_row(spark):
    """Rows of one id that each meet one foot are no meeting; a row that meets both is."""
    schema = "id int, a struct<chrom:string,start:long,end:long>, b struct<chrom:string,start:long,end:long>"
    p = spark.createDataFrame([(1, ("c", 0, 5), ("c", 90, 95))], schema)
    o = spark.createDataFrame([(7, ("c", 1, 2), ("d", 0, 9)), (7, ("d", 0, 9), ("c", 91, 92)), (8, ("c", 94, 99), ("c", 4, 9)), (9, ("c", 0, 99), ("d", 0, 1)), (6, ("c", 3, 3), ("c", 90, 91))], schema)
    assert rows(pairs.pairs_meeting(p, o)) == [(1, 8), (1, 9)]


def test_ancestors(spark):
    t = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["c", "a"]), ("e", ["d"])], "id string, parents array<string>")
    up = {}
    for i, a in rows(pairs.ancestors(t)):
        up.setdefault(i, set()).add(a)
    assert up == {"a": {"a"}, "b": {"a", "b"}, "c": {"a", "b", "c"}, "d": {"a", "b", "c", "d"}, "e": {"a", "b", "c", "d", "e"}}


def test_motifs(spark):
    seqs = spark.createDataFrame([("s", "AACGTTnGA"), ("t", "A")], "name string, seq string")
    matrix = [dict(zip("ACGT", x, strict=True)) for x in ((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0))]
    assert rows(pairs.motif_hits(seqs, matrix, 1.0)) == [("s", 1, 4, "+", 3.0), ("s", 2, 5, "-", 3.0)]


def test_equal_pairs_of_a_batch_are_aligned_once(spark, monkeypatch):
    import pandas as pd

    from spanframe.operators import alignment

    seen = []
    kept = {}
    monkeypatch.setattr(alignment, "align", lambda a, b, local=False: seen.append((a, b)) or align(a, b, local))
    monkeypatch.setattr(alignment.F, "pandas_udf", lambda f, kind: kept.update(run=f) or (lambda *columns: None))
    alignment.align_columns(None, None)
    left, right = pd.Series(["ACGT", None, "ACGT"] * 100), pd.Series(["AGT", "A", "AGT"] * 100)
    (out,) = kept["run"](iter([(left, right)]))
    assert len(out) == 300 and sorted(seen) == [("", "A"), ("ACGT", "AGT")]
    assert [tuple(r) for r in out.itertuples(index=False)] == [align(x or "", y or "") for x, y in zip(left, right, strict=True)]


def plain_score(a, b):
    low = -1e18
    n, m = len(a), len(b)
    best = [[[low] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    best[0][0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                best[i][j][0] = max(best[i - 1][j - 1]) + (MATCH if a[i - 1] == b[j - 1] else MISMATCH)
            if j:
                best[i][j][1] = max(max(best[i][j - 1]) + GAP_OPEN, best[i][j - 1][1]) + GAP_EXTEND
            if i:
                best[i][j][2] = max(max(best[i - 1][j]) + GAP_OPEN, best[i - 1][j][2]) + GAP_EXTEND
    return max(best[n][m])


def test_alignment_is_optimal():
    r = random.Random(1)
    for _ in range(150):
        a, b = ("".join(r.choice("ACG") for _ in range(r.randrange(12))) for _ in range(2))
        score, code, i, j = align(a, b)
        assert abs(score - plain_score(a, b)) < 1e-9, (a, b)
        run, at, to, again = "", 0, 0, 0.0
        for c in code:
            if c.isdigit():
                run += c
                continue
            k, run = int(run), ""
            if c == "M":
                again += sum(MATCH if a[at + x] == b[to + x] else MISMATCH for x in range(k))
            else:
                again += GAP_OPEN + GAP_EXTEND * k
            at, to = at + k * (c in "MD"), to + k * (c in "MI")
        assert (at, to, i, j) == (len(a), len(b), 0, 0) and abs(again - score) < 1e-9, (a, b, code)
    assert align("TTACGTT", "GGACGGG", local=True) == (3.0, "3M", 2, 2)


def test_simulation(spark):
    regions = simulate.random_regions(spark, 200, [("a", 100), ("b", 5), ("c", 50)], 10)
    got = rows(regions, "chrom", "start", "end")
    assert got == rows(regions, "chrom", "start", "end") and {c for c, _, _ in got} == {"a", "c"}
    assert all(0 <= s and e - s == 10 and e <= {"a": 100, "c": 50}[c] for c, s, e in got)
    seqs = simulate.random_sequences(spark, 20, 500, gc=0.7).collect()
    share = sum(r["seq"].count("G") + r["seq"].count("C") for r in seqs) / 10000
    assert abs(share - 0.7) < 0.03 and len({r["seq"] for r in seqs}) == 20
