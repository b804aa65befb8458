"""Interval joins against plain nested loops, on every relation and awkward coordinates."""

import random

import pytest

from spanframe.operators import genomics
from spanframe.operators import intervals as iv

TESTS = {
    "o": lambda a, b, x, y: a < x < b < y,
    "oi": lambda a, b, x, y: x < a < y < b,
    "d": lambda a, b, x, y: a > x and b < y,
    "di": lambda a, b, x, y: a < x and b > y,
    "m": lambda a, b, x, y: b == x and a != b,
    "mi": lambda a, b, x, y: a == y and a != b,
    "s": lambda a, b, x, y: a == x and b < y,
    "si": lambda a, b, x, y: a == x and b > y,
    "f": lambda a, b, x, y: a > x and b == y,
    "fi": lambda a, b, x, y: a < x and b == y,
    "lt": lambda a, b, x, y: b < x,
    "gt": lambda a, b, x, y: a > y,
    "e": lambda a, b, x, y: (a, b) == (x, y),
    "any": lambda a, b, x, y: a <= y and b >= x,
    "within": lambda a, b, x, y: a >= x and b <= y,
    "start": lambda a, b, x, y: a == x,
    "end": lambda a, b, x, y: b == y,
    "equal": lambda a, b, x, y: (a, b) == (x, y),
}


def table(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.choice([r.randrange(12), r.randrange(3000), 64 * r.randrange(9)])
        rows.append((r.choice("ab"), start, start + r.choice([0, 1, 1, 2, 5, 64, 700, 9000, 400000]), i))
    return rows


@pytest.fixture(scope="module")
def sides(spark):
    q, t = table(1, 60), [*table(2, 60), ("c", 1, 2, 99)]
    schema = "chrom string, start long, end long, id int"
    return q, t, spark.createDataFrame(q, schema), spark.createDataFrame(t, schema)


@pytest.mark.parametrize("relation", iv.RELATIONS)
def test_relation(sides, relation):
    q, t, dq, dt = sides
    got = sorted((r["q_id"], r["t_id"]) for r in iv.overlap_join(dq, dt, relation).select("q_id", "t_id").collect())
    want = sorted((i, j) for c, x, y, i in q for e, a, b, j in t if c == e and y > x and b > a and TESTS[relation](a, b - 1, x, y - 1))
    assert got == want


def test_semi_anti_and_thresholds(sides):
    q, t, dq, dt = sides
    hit = {i for c, x, y, i in q for e, a, b, _ in t if c == e and y > x and b > a and a < y and b > x}
    assert {r["id"] for r in iv.overlapping(dq, dt).collect()} == hit
    assert {r["id"] for r in iv.not_overlapping(dq, dt).collect()} == {i for *_, i in q} - hit
    half = sorted((i, j) for c, x, y, i in q for e, a, b, j in t if c == e and y > x and b > a and a < y and b > x and min(b, y) - max(a, x) >= 0.5 * (y - x))
    assert sorted((r["q_id"], r["t_id"]) for r in iv.overlap_join(dq, dt, threshold=0.5).collect()) == half


def test_no_row_makes_many_bins(sides):
    _, _, dq, dt = sides
    per = iv._Bins(dq, dt).listed(dq, 0).groupBy("id", "__tag").count().agg({"count": "max"}).first()[0]
    assert per <= iv.SPAN + 1


def test_overlap_join_is_an_equi_join(sides):
    _, _, dq, dt = sides
    plan = iv.overlap_join(dq, dt)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unknown_relation(sides):
    with pytest.raises(ValueError):
        iv.overlap_join(sides[2], sides[3], "beside")


def test_lengths_of_every_order_meet_once(spark):
    """Intervals from one position to billions, on both sides: no pair is lost, none is found twice."""
    r = random.Random(11)
    made = lambda n: [("c", s := r.randrange(3_000_000), s + 1 + int(10 ** r.uniform(0, 9.9)), i) for i in range(n)] + [("c", 5, 5, n), ("d", 1, 1 << 40, n + 1)]
    q, t = made(150), made(150)
    kind = "chrom string, start long, end long, id int"
    dq, dt = spark.createDataFrame(q, kind), spark.createDataFrame(t, kind)
    want = sorted((a[3], b[3]) for a in q for b in t if a[0] == b[0] and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])
    assert sorted((x["q_id"], x["t_id"]) for x in iv.overlap_join(dq, dt).select("q_id", "t_id").collect()) == want
    assert iv._Bins(dq, dt).listed(dq, 0).groupBy("id", "__tag").count().agg({"count": "max"}).first()[0] <= iv.SPAN + 1
    assert {x["id"] for x in iv.overlapping(dq, dt).collect()} == {a for a, _ in want}
    for relation, holds in (("lt", lambda a, b: b[2] - 1 < a[1]), ("gt", lambda a, b: b[1] > a[2] - 1)):
        got = {x["id"] for x in iv.overlapping(dq, dt, relation=relation).collect()}
        assert got == {a[3] for a in q for b in t if a[0] == b[0] and a[1] < a[2] and b[1] < b[2] and holds(a, b)}


@pytest.mark.parametrize("relation", ["lt", "gt"])
def test_pairs_apart_are_counted_without_being_made(spark, sides, relation):
    q, t, dq, dt = sides
    want = {}
    for c, x, y, _ in q:
        for e, a, b, _ in t:
            if c == e and y > x and b > a and TESTS[relation](a, b - 1, x, y - 1):
                want[c] = want.get(c, 0) + 1
    assert {r["chrom"]: r["pairs"] for r in iv.pairs_apart(dq, dt, relation).collect()} == want
    # 200,000 intervals on either side of one place: 4e10 pairs, more than can be made in a test.
    early = spark.range(200_000).selectExpr("'c' as chrom", "id % 50 as start", "id % 50 + 1 as end")
    late = spark.range(200_000).selectExpr("'c' as chrom", "100 + id % 50 as start", "101 + id % 50 as end")
    pair = (late, early) if relation == "lt" else (early, late)
    assert [tuple(r) for r in iv.pairs_apart(*pair, relation).collect()] == [("c", 200_000**2)]


def crowded(spark, n, *more):
    """n intervals that all meet at one place."""
    return spark.range(n).selectExpr("'c' as chrom", "id % 50 as start", "60 + id % 50 as end", *more)


def test_cells_and_genes_are_counted_without_pairs(spark):
    # 4e10 pairs: more than can be made in a test. Gene x covers all reads, gene y only those that reach place 105.
    reads = crowded(spark, 200_000, "id as read_id", "if(id % 2 = 0, 'even', 'odd') as cell")
    genes = crowded(spark, 200_000, "'x' as gene").union(spark.sql("select 'c', 105L, 120L, 'y'"))
    want = {}
    for i in range(200_000):
        if 60 + i % 50 <= 105:
            want[("odd" if i % 2 else "even", "x")] = want.get(("odd" if i % 2 else "even", "x"), 0) + 1
    assert {(r["cell"], r["gene"]): r["reads"] for r in genomics.cell_gene_counts(reads, genes).collect()} == want


def test_cells_and_genes_against_plain_loops(spark):
    r = random.Random(5)
    kind = "chrom string, start long, end long, "
    made = lambda n, what: [(r.choice(["a", "b", None]), s := r.randrange(300), s + r.choice([-1, 0, 1, 7, 30]), *what()) for _ in range(n)]
    reads = made(150, lambda: (r.randrange(90), r.choice("ABC")))  # some reads in several rows
    genes = made(25, lambda: (r.choice(["g", "h", "i", None]),))
    got = genomics.cell_gene_counts(spark.createDataFrame(reads, kind + "read_id int, cell string"), spark.createDataFrame(genes, kind + "gene string"))
    met = {}
    for c, x, y, i, cell in reads:
        for e, a, b, g in genes:
            if c is not None and c == e and y > x and b > a and a < y and x < b:
                met.setdefault(i, []).append((cell, g))
    want = {}
    for found in met.values():
        names = {g for _, g in found} - {None}
        if len(names) == 1:
            key = (min(cell for cell, _ in found), names.pop())
            want[key] = want.get(key, 0) + 1
    assert {(x["cell"], x["gene"]): x["reads"] for x in got.collect()} == want and want


def test_subset_matrix_makes_no_pairs(spark, sides):
    q, t, dq, dt = sides
    names = ["0", "1", "2"]
    out = iv.subset_matrix(dq, dt.selectExpr("chrom", "start", "end", "cast(id % 4 as string) as name"), names).collect()
    hit = lambda c, x, y, n: int(any(c == e and y > x and b > a and a < y and x < b and str(j % 4) == n for e, a, b, j in t))
    assert {tuple(r) for r in out} == {(c, x, y, *[hit(c, x, y, n) for n in names]) for c, x, y, _ in q} and len(out) == len({row[:3] for row in q})
    crowd = crowded(spark, 200_000, "'n' as name", "id")
    regions = spark.range(100_000).selectExpr("'c' as chrom", "-1 - id as start", "200 + id as end")  # 2e10 pairs
    assert iv.subset_matrix(regions, crowd, ["n", "m"]).groupBy("n", "m").count().collect()[0].asDict() == {"n": 1, "m": 0, "count": 100_000}


def test_cores_list_one_bin_and_lose_no_pair(spark):
    """Where a partner must contain one place of a side, that side lists one bin a tag; every relation and share still finds all."""
    r = random.Random(3)
    made = lambda n: [("c", s := r.randrange(400), s + r.choice([1, 2, 3, 4, 31, 32, 33, 64, 500, 5000]), i) for i in range(n)]
    q, t = made(120), made(120)
    kind = "chrom string, start long, end long, id int"
    dq, dt = spark.createDataFrame(q, kind), spark.createDataFrame(t, kind)
    for relation in ("o", "oi", "d", "di", "within"):
        got = sorted((x["q_id"], x["t_id"]) for x in iv.overlap_join(dq, dt, relation).select("q_id", "t_id").collect())
        assert got == sorted((i, j) for _, x, y, i in q for _, a, b, j in t if TESTS[relation](a, b - 1, x, y - 1))
        side = 0 if iv._CORES[relation][0] else 1
        listed = iv._Bins(dq, dt, iv._CORES[relation]).listed((dq, dt)[side], side)
        assert listed.groupBy("id", "__tag").count().agg({"count": "max"}).first()[0] == 1
    for share in (0.5, 0.75):
        shared = [(i, j, min(b, y) - max(a, x), y - x, b - a) for _, x, y, i in q for _, a, b, j in t]
        got = lambda **how: sorted((x["q_id"], x["t_id"]) for x in iv.overlap_join(dq, dt, **how).select("q_id", "t_id").collect())
        assert got(threshold=share) == sorted((i, j) for i, j, k, n, _ in shared if k >= share * n)
        assert got(reciprocal=share) == sorted((i, j) for i, j, k, n, m in shared if k >= share * n and k >= share * m)


def uneven(spark, n, m):
    """n queries and m targets of many lengths, as rows and as frames."""
    r = random.Random(17)
    made = lambda k: [(r.choice("ab"), s := r.randrange(-600, 600), s + r.choice([0, 1, 2, 3, 4, 31, 32, 33, 64, 500, 40_000]), i) for i in range(k)]
    q, t = made(n), made(m)
    kind = "chrom string, start long, end long, id int"
    return q, t, spark.createDataFrame(q, kind), spark.createDataFrame(t, kind)


def met(q, t, holds):
    return sorted((i, j) for c, x, y, i in q for e, a, b, j in t if c == e and y > x and b > a and holds(a, b - 1, x, y - 1))


def joined(dq, dt, *args, **how):
    return sorted((r["q_id"], r["t_id"]) for r in iv.overlap_join(dq, dt, *args, **how).select("q_id", "t_id").collect())


def listed_rows(bins, df, side):
    out = bins.listed(df, side)
    return out.groupBy("id", "__tag").count().agg({"count": "max"}).first()[0], "__bin" in out.columns


@pytest.mark.parametrize("relation", ["d", "oi", "within", "o", "di"])
@pytest.mark.parametrize("sizes", [(400, 25), (25, 400)])
def test_the_larger_side_lists_one_place(spark, relation, sizes):
    """Whichever side is larger, it makes one row a tag, its bin is not shuffled, and no pair is lost."""
    q, t, dq, dt = uneven(spark, *sizes)
    assert joined(dq, dt, relation) == met(q, t, TESTS[relation])
    bins, larger = iv._Bins(dq, dt, iv._CORES[relation]), int(sizes[1] > sizes[0])
    assert listed_rows(bins, (dq, dt)[larger], larger) == (1, False)
    most, has_bin = listed_rows(bins, (dq, dt)[1 - larger], 1 - larger)
    assert most <= iv.SPAN + 2 and has_bin


@pytest.mark.parametrize("how", ["threshold", "reciprocal"])
@pytest.mark.parametrize("sizes", [(400, 25), (25, 400)])
def test_shares_list_one_place_of_the_larger_side(spark, how, sizes):
    """Of two middle places one is listed, also where they lie in two bins."""
    q, t, dq, dt = uneven(spark, *sizes)
    for share in (0.5, 0.75, 1.0):
        shared = lambda a, b, x, y: min(b, y) - max(a, x) + 1
        holds = lambda a, b, x, y: shared(a, b, x, y) >= share * (y - x + 1) and (how == "threshold" or shared(a, b, x, y) >= share * (b - a + 1))  # noqa: E731, B023
        assert joined(dq, dt, **{how: share}) == met(q, t, holds)
    bins, larger = iv._Bins(dq, dt, (iv._MIDDLE, None)), int(sizes[1] > sizes[0])
    assert listed_rows(bins, (dq, dt)[larger], larger) == (1, False)


@pytest.mark.parametrize("relation", ["o", "oi", "d", "di", "within", "any"])
def test_large_sides_lose_no_pair_in_order(spark, monkeypatch, relation):
    monkeypatch.setattr(iv, "ORDERED_FROM", 0, raising=False)
    for sizes in ((150, 25), (25, 150)):
        q, t, dq, dt = uneven(spark, *sizes)
        assert joined(dq, dt, relation) == met(q, t, TESTS[relation])


@pytest.mark.parametrize("how", [{"relation": "o"}, {"relation": "oi"}, {"threshold": 0.5}, {"reciprocal": 0.5}], ids=str)
def test_pairs_of_large_sides_are_written_in_few_bytes(spark, monkeypatch, tmp_path, how):
    """Neighbouring queries list much the same partners in the same row, so a file of pairs takes under a byte a pair; in no order it takes over 1.2."""
    monkeypatch.setattr(iv, "ORDERED_FROM", 0, raising=False)
    made = lambda n, k: spark.range(n).selectExpr("'c' as chrom", f"hash(id, {k}) % 200 as start", "id").selectExpr("chrom", "cast(start as long) as start", f"start + 1 + pmod(hash(id, {k + 1}), 40) as end", "id")
    pairs = iv.overlap_join(made(20_000, 1), made(1_000, 3), **how).select("q_id", "t_id")
    pairs.write.parquet(str(tmp_path / "pairs"))
    written = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n > 100_000 and written < n


@pytest.mark.parametrize("how", [{"relation": "o"}, {"relation": "oi"}, {"threshold": 0.5}], ids=str)
def test_files_of_pairs_of_large_sides_keep_their_dictionaries(spark, monkeypatch, tmp_path, how):
    """A file of pairs has no more numbers than a Parquet dictionary holds, however few the shuffle's partitions; else each pair costs 8 bytes before compression."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(iv, "ORDERED_FROM", 0)
    made = lambda n, k: spark.range(n).selectExpr(f"cast(pmod(hash(id, {k + 2}), 100) as string) as chrom", f"pmod(hash(id, {k}), 200) as start", "id").selectExpr("chrom", "cast(start as long) as start", f"start + 1 + pmod(hash(id, {k + 1}), 40) as end", "id")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        iv.overlap_join(made(200_000, 1), made(8_000, 5), **how).select("q_id", "t_id").write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    metas = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    columns = [m.row_group(g).column(c) for m in metas for g in range(m.num_row_groups) for c in range(2)]
    assert sum(m.num_rows for m in metas) > 200_000 and not [c.path_in_schema for c in columns if "PLAIN" in c.encodings]
