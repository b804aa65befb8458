"""Interval joins: every Allen relation, inner, semi and anti, with coverage thresholds.

An interval view is a DataFrame with columns chrom, start, end: half-open, zero-based. Queries are the left
side, targets the right. Relations are stated on closed ends: the query is [x, y], the target [a, b].

Overlap joins become equi-joins on (chrom, tag, bin), a tag being a level and the side that hosts there. The sizes of the bins follow the intervals' lengths, which
one small aggregation counts by powers of two: the finest bin is about as long as the usual interval, each further level's
is FACTOR times as long, and there are as many levels as the longest interval needs. An interval's own level is the
least whose bins it spans at most SPAN + 1 of, so it makes no more rows than that on a level, however long. On its own
level it hosts; on the coarser levels that the other side has hosts on, it visits. Hosts meet hosts and visitors meet hosts
of one bin; two visitors never meet. A pair so is found on the coarser of its two levels only, in the first bin that both
touch. Where a relation makes one side contain a place of the other, one of the sides is looked up by a single place, whose
bin is an expression and no shuffled column, and the other lists the bins of all places that can meet it, at most SPAN + 2
a level. Relations that fix an end are plain equi-joins on it.

An interval of length zero or less overlaps nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTOR = 8
SPAN = 4
#: Sides with so many rows in all are joined in the order that makes partners' runs alike. Below, Spark may broadcast one.
ORDERED_FROM = 10_000_000
#: Rows of the larger side in a task of such a join, so that the 131,072 numbers that a Parquet dictionary holds suffice for its file.
ORDERED_ROWS = 1 << 16

#: SQL of each relation over the target's closed ends a, b and the query's x, y.
RELATIONS = {
    "o": "a < x and b > x and b < y",
    "oi": "a > x and a < y and b > y",
    "d": "a > x and b < y and b >= a",
    "di": "a < x and b > y",
    "m": "a <= x and b = x and a <> b",
    "mi": "a = y and b >= y and a <> b",
    "s": "a = x and b < y",
    "si": "a = x and b > y",
    "f": "a > x and b = y",
    "fi": "a < x and b = y",
    "lt": "b < x",
    "gt": "a > y",
    "e": "a = x and b = y",
    "any": "a <= y and b >= x",
    "within": "a >= x and b <= y",
    "start": "a = x",
    "end": "b = y",
    "equal": "a = x and b = y",
}
#: Relations that fix ends: (target end, query end) pairs that must be equal.
_FIXED = {"m": [("b", "x")], "mi": [("a", "y")], "s": [("a", "x")], "si": [("a", "x")], "f": [("b", "y")], "fi": [("b", "y")], "e": [("a", "x"), ("b", "y")], "start": [("a", "x")], "end": [("b", "y")], "equal": [("a", "x"), ("b", "y")]}


#: Of a side (query, target) a place, and how many places more: every partner contains one of them. Of two middle places the first is named.
_START, _MIDDLE = ("start", 0), ("start + (end - start - 1) div 2", 1)
_CORES = {"o": (_START, None), "di": (_START, None), "oi": (None, _START), "d": (None, _START), "within": (None, _START)}

#: Of a bin's queries and targets the order in which neighbouring queries have much the same partners in much the same row: those of
#: one start (or end) take more or fewer from one end of a list.
_ORDERS = {"oi": (("end", "start"), ("start", "end"))} | dict.fromkeys(("o", "di", "d", "within"), (("start", "end"), ("end", "start")))
_MIDDLES = (("start + end", "start"), ("start", "end"))


def as_intervals(df: DataFrame, chrom: Column | str, start: Column | str, end: Column | str, *keep: str) -> DataFrame:
    """An interval view of any frame, with further columns to keep."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(chrom).cast("string").alias("chrom"), col(start).cast("long").alias("start"), col(end).cast("long").alias("end"), *keep)


def _power(start: Column, end: Column) -> Column:
    """The power of two that a length reaches."""
    return F.floor(F.log2((end - start).cast("double"))).cast("int")


class _Bins:
    """Bin sizes for two sides, and the levels on which each has hosts."""

    def __init__(self, queries: DataFrame, targets: DataFrame, cores: tuple = (None, None)):
        side = lambda df, k: df.where("end > start").select(F.lit(k).alias("k"), _power(F.col("start"), F.col("end")).alias("p"), F.expr("end - start").alias("l"))
        counts = side(queries, 0).union(side(targets, 1)).groupBy("k", "p").agg(F.count("*").alias("n"), F.max("l").alias("l")).collect()  # at most 64 powers a side
        self.rows = n = sum(r["n"] for r in counts)
        self.sizes = [sum(r["n"] for r in counts if r["k"] == k) for k in (0, 1)]
        self.base = 1 + round(sum(r["p"] * r["n"] for r in counts) / n) if n else 0
        self.base += any(cores)  # one side lists one bin, so bins can be larger for as many candidates
        #: Of each side its greatest length on each level.
        self.longest = [{level: max(r["l"] for r in counts if r["k"] == k and self._own(r["p"]) == level) for level in sorted({self._own(r["p"]) for r in counts if r["k"] == k})} for k in (0, 1)]
        self.hosts = [[*found] for found in self.longest]
        self.core = next((c for c in cores if c), None)
        self.core_side = cores.index(self.core) if self.core else None
        #: The side of which one place alone is looked up: the one with the core, or the other by its start if that makes fewer rows.
        self.point = self.core_side
        if self.core:
            here, there = ([r for r in counts if (r["k"] == self.core_side) == own] for own in (True, False))
            reach = sum(1 + length / self.size(level) for level, length in self.longest[1 - self.core_side].items())
            kept = sum(r["n"] for r in here) + sum(r["n"] * (1 + 1.5 * 2 ** r["p"] / self.size(self._own(r["p"]))) for r in there)
            if sum(r["n"] for r in there) + sum(r["n"] for r in here) * reach < kept:
                self.point = 1 - self.core_side

    def size(self, level: int) -> int:
        return 1 << self.base + level * (FACTOR.bit_length() - 1)

    def _own(self, power: int) -> int:
        """The level of lengths under 2 ** (power + 1)."""
        return max(0, -(-(power + 1 - self.base - (SPAN.bit_length() - 1)) // (FACTOR.bit_length() - 1)))

    def _bits(self, tag: Column) -> Column:
        """The power of two of the bins' size; a tag is twice the level, and one more where targets host."""
        return (F.lit(self.base) + F.shiftright(tag, 1) * (FACTOR.bit_length() - 1)).cast("int")

    def _tests(self, side: int) -> list[tuple[int, str, int]]:
        """The tags under which intervals of a side are listed, and what their own levels must be."""
        least = [min(h) if h else None for h in self.hosts]
        tests = []
        if None not in least:
            tests += [(2 * level, "=" if side == 0 else "<=", level) for level in self.hosts[0] if least[1] <= level]
            tests += [(2 * level + 1, "<" if side == 0 else "=", level) for level in self.hosts[1] if least[0] < level]
        return tests

    def _ends(self) -> tuple[str, str]:
        """First and last place whose bins the other side than ``point`` lists."""
        place, more = self.core
        if self.point == self.core_side:
            return f"start - {more}", "end - 1"
        # What begins more than its length before the place can't contain it.
        met = {"=": lambda own, level: own == level, "<=": lambda own, level: own <= level, "<": lambda own, level: own < level}
        back = [(tag, max(length for own, length in self.longest[self.point].items() if met[how](own, level)) - 1) for tag, how, level in self._tests(self.point)]
        far = str(back[0][1]) if len(back) == 1 else f"case __tag {' '.join(f'when {tag} then {n}' for tag, n in back)} end" if back else "0"
        return f"{place} - ({far})", f"{place} + {more}"

    def listed(self, df: DataFrame, side: int) -> DataFrame:
        """One row for each tag and bin of an interval; of the side ``point`` one for each tag, whose bin ``key`` tells.

        Under even tags queries host and targets of the same or finer levels visit, under odd ones targets host and queries
        of finer levels visit. Tags under which the other side has nobody are left out. All of it stays in generated code.
        """
        tests = self._tests(side)
        own = F.greatest(F.lit(0), F.ceil((_power(F.col("start"), F.col("end")) + 1 - self.base - (SPAN.bit_length() - 1)) / (FACTOR.bit_length() - 1))).cast("int")
        held = df.where("end > start").withColumn("__own", own)
        if len(tests) == 1 and len({*self.hosts[side]}) == 1:
            tagged = held.withColumn("__tag", F.lit(tests[0][0]))  # one level only, so each interval passes the one test
        else:
            tags = F.expr(f"array({', '.join(f'if(__own {how} {level}, {tag}, null)' for tag, how, level in tests)})" if tests else "cast(array() as array<int>)")
            tagged = held.withColumn("__tag", F.explode(tags)).where("__tag is not null")
        if side == self.point:
            return tagged.drop("__own")
        bits = self._bits(F.col("__tag"))
        first, last = (F.expr(x) for x in (self._ends() if self.core else ("start", "end - 1")))
        return tagged.drop("__own").withColumn("__bin", F.explode(F.sequence(_shifted(first, bits), _shifted(last, bits))))

    def key(self, side: int) -> Column:
        """The bin of a listed row, its columns named as in a pair. A place's is computed where it is needed, so that it is not shuffled."""
        p = ("q_", "t_")[side]
        if side != self.point:
            return F.col(f"{p}__bin")
        place = self.core[0] if side == self.core_side else "start"
        return _shifted(F.expr(place.replace("start", f"{p}start").replace("end", f"{p}end")), self._bits(F.col(f"{p}__tag")))

    def once(self) -> Column:
        """Whether a pair meets in the first bin that both touch, at the tag under which they meet; a place has one bin only."""
        if self.core:
            return F.lit(True)
        return F.col("q___bin") == _shifted(F.greatest("q_start", "t_start"), self._bits(F.col("q___tag")))


def _shifted(place: Column, bits: Column) -> Column:
    return F.call_function("shiftright", place, bits)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def _relation(relation: str) -> Column:
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    sql = RELATIONS[relation]
    ends = {"a": "t_start", "b": "(t_end - 1)", "x": "q_start", "y": "(q_end - 1)"}
    return F.expr(" ".join(ends.get(w, w) for w in sql.split(" ")))


def overlap_join(queries: DataFrame, targets: DataFrame, relation: str = "any", threshold: float | None = None, reciprocal: float | None = None) -> DataFrame:
    """All pairs in the relation, the query's columns as q_*, the target's as t_*.

    threshold: least share of the query that the single target covers; reciprocal: of both.
    ``lt`` and ``gt`` pair whole sides of a chromosome; their result itself is quadratic, and ``pairs_apart`` counts it.
    """
    holds = _relation(relation)
    if relation in ("lt", "gt"):
        q, t = _prefixed(queries.where("end > start"), "q_"), _prefixed(targets.where("end > start"), "t_")
        return q.join(t, (F.col("q_chrom") == F.col("t_chrom")) & holds)
    if relation in _FIXED:
        q, t = _prefixed(queries.where("end > start"), "q_"), _prefixed(targets.where("end > start"), "t_")
        ends = {"a": F.col("t_start"), "b": F.col("t_end") - 1, "x": F.col("q_start"), "y": F.col("q_end") - 1}
        on = F.col("q_chrom") == F.col("t_chrom")
        for target, query in _FIXED[relation]:
            on = on & (ends[target] == ends[query])
        return _thresholds(q.join(t, on & holds), threshold, reciprocal)
    # A target that covers half of a query contains its middle place or, of two, one of them.
    half = relation == "any" and max(threshold or 0.0, reciprocal or 0.0) >= 0.5
    bins = _Bins(queries, targets, (_MIDDLE, None) if half else _CORES.get(relation, (None, None)))
    q, t, same = _met(queries, targets, bins, _MIDDLES if half else _ORDERS.get(relation))
    pairs = q.join(t, same & bins.once() & holds).drop(*[f"{p}__{c}" for p in ("q_", "t_") for c in ("tag", "bin")])
    return _thresholds(pairs, threshold, reciprocal)


def pairs_apart(queries: DataFrame, targets: DataFrame, relation: str) -> DataFrame:
    """Number of pairs in ``lt`` or ``gt`` by chromosome: chrom, pairs. Chromosomes without a pair are left out.

    No pairs are made: intervals are counted by the end that matters, and each start takes the running count of the other
    side's intervals that have ended by then.
    """
    if relation not in ("lt", "gt"):
        raise ValueError(f"{relation!r} is not lt or gt")
    ends, starts = (targets, queries) if relation == "lt" else (queries, targets)
    zero = F.lit(0).cast("long")
    side = lambda df, at, ended, begun: df.where("end > start").select("chrom", F.col(at).alias("pos"), ended.alias("ended"), begun.alias("begun"))
    places = side(ends, "end", zero + 1, zero).union(side(starts, "start", zero, zero + 1)).groupBy("chrom", "pos").agg(F.sum("ended").alias("ended"), F.sum("begun").alias("begun"))
    w = Window.partitionBy("chrom").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = places.select("chrom", (F.col("begun") * F.sum("ended").over(w)).alias("pairs"))
    return counted.groupBy("chrom").agg(F.sum("pairs").alias("pairs")).where("chrom is not null and pairs > 0")


def _met(queries: DataFrame, targets: DataFrame, bins: _Bins, orders: tuple | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides listed, and when their rows meet.

    orders: of large sides, the order of a bin's rows. Pairs come out query by query, so that where neighbours have the same partners in the
    same row, files of pairs repeat what they hold and compress; in no order each pair costs them as many bits as a target's number.
    The number of tasks follows the rows, as a file of more numbers than a dictionary holds has every pair's numbers in full.
    """
    q, t = _prefixed(bins.listed(queries, 0), "q_"), _prefixed(bins.listed(targets, 1), "t_")
    if orders and bins.rows >= ORDERED_FROM:
        sides = []
        for side, df in enumerate((q, t)):
            p = ("q_", "t_")[side]
            tag = [F.col(f"{p}__tag")] if len(bins._tests(side)) > 1 else []  # a lone tag is folded out of the join's keys
            keys = [F.col(f"{p}chrom"), *tag, bins.key(side)]
            within = [F.expr(re.sub(r"\b(start|end)\b", rf"{p}\1", x)) for x in orders[side]]
            # The optimizer takes sorts away below a join; it doesn't look through a filter whose outcome it can't know.
            sides.append(df.repartition(-(-max(bins.sizes) // ORDERED_ROWS), *keys).sortWithinPartitions(*keys, *within).where(F.spark_partition_id() >= 0))
        q, t = sides
    return q, t, (F.col("q_chrom") == F.col("t_chrom")) & (F.col("q___tag") == F.col("t___tag")) & (bins.key(0) == bins.key(1))


def _covers(threshold: float | None, reciprocal: float | None) -> Column:
    shared = overlap_length(F.col("q_start"), F.col("q_end"), F.col("t_start"), F.col("t_end"))
    out, q, t = F.lit(True), F.col("q_end") - F.col("q_start"), F.col("t_end") - F.col("t_start")
    if threshold is not None:
        out = out & (shared >= threshold * q)
    if reciprocal is not None:
        out = out & (shared >= reciprocal * q) & (shared >= reciprocal * t)
    return out


def _thresholds(pairs: DataFrame, threshold: float | None, reciprocal: float | None) -> DataFrame:
    return pairs if threshold is None and reciprocal is None else pairs.where(_covers(threshold, reciprocal))


def _matched(queries: DataFrame, targets: DataFrame, relation: str = "any", threshold: float | None = None, reciprocal: float | None = None) -> DataFrame:
    """Coordinates of the queries with a partner. Whether one has is a matter of its coordinates alone.

    No pairs are made: a query's search ends at its first partner.
    """
    sides = queries, targets
    keys = queries.where("end > start").select("chrom", "start", "end").distinct()
    targets = targets.where("end > start").select("chrom", "start", "end").distinct()
    holds = _relation(relation) & _covers(threshold, reciprocal)
    named = [F.col(f"q_{c}").alias(c) for c in ("chrom", "start", "end")]
    if relation in ("lt", "gt") and threshold is None and reciprocal is None:
        # Some target lies before a query if the one that ends first does, and after it if the one that begins last does.
        ends = targets.groupBy("chrom").agg(F.min(F.col("end") - 1).alias("b"), F.max("start").alias("a"))
        return keys.join(ends, "chrom").where("b < start" if relation == "lt" else "a > end - 1").select("chrom", "start", "end")
    if relation in _FIXED or relation in ("lt", "gt"):
        q, t = _prefixed(keys, "q_"), _prefixed(targets, "t_")
        ends = {"a": F.col("t_start"), "b": F.col("t_end") - 1, "x": F.col("q_start"), "y": F.col("q_end") - 1}
        on = F.col("q_chrom") == F.col("t_chrom")
        for target, query in _FIXED.get(relation, ()):
            on = on & (ends[target] == ends[query])
        return q.join(t, on & holds, "left_semi").select(*named)
    q, t, same = _met(keys, targets, _Bins(*sides))
    return q.join(t, same & holds, "left_semi").select(*named).distinct()


def overlapping(queries: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The queries with at least one target in the relation; each row once."""
    return queries.join(_matched(queries, targets, **options), ["chrom", "start", "end"], "left_semi").select(*queries.columns)


def not_overlapping(queries: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The queries without a target in the relation."""
    return queries.join(_matched(queries, targets, **options), ["chrom", "start", "end"], "left_anti").select(*queries.columns)


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Positions that two intervals of one chromosome share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """0 for overlapping intervals, else the gap and one: touching intervals are at distance 1."""
    return F.greatest(F.lit(0), F.greatest(a_start, b_start) - F.least(a_end, b_end) + 1)


def aggregate_overlaps(queries: DataFrame, targets: DataFrame, *aggs: Column, **options) -> DataFrame:
    """For each query row's coordinates, aggregates over its targets."""
    return overlap_join(queries, targets, **options).groupBy("q_chrom", "q_start", "q_end").agg(*aggs)


def overlap_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: number of overlapping pairs, and positions that they share."""
    pairs = overlap_join(a, b)
    shared = overlap_length(F.col("q_start"), F.col("q_end"), F.col("t_start"), F.col("t_end"))
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(shared), F.lit(0)).alias("shared"))


def met_sums(queries: DataFrame, targets: DataFrame, wide: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """queries with sums over each row's overlapping targets, 0 where there are none; no pairs are made.

    values: whole numbers of a target by the name of their sum; a null counts as 0. wide: those whose sums over a chromosome may pass a
    long. Targets that begin before a query ends, less those that end by its start, are the ones that overlap it; so
    two running sums over the places serve, and two equi-joins on (chrom, place), however many pairs there are.
    """
    names = list(values)
    typed = lambda c, n: F.coalesce(c, F.lit(0)).cast("decimal(38,0)" if n in wide else "long")
    held = targets.where("end > start").select("chrom", "start", "end", *[typed(v, n).alias(n) for n, v in values.items()])
    asked = queries.where("end > start").select("chrom", F.explode(F.array("start", "end")).alias("pos")).distinct()
    none = [F.lit(None).cast(held.schema[n].dataType).alias(f"__{k}_{n}") for k in "be" for n in names]
    steps = lambda at, k: held.groupBy("chrom", F.col(at).alias("pos")).agg(*[(typed(F.sum(n), n) if k == j else F.lit(None).cast(held.schema[n].dataType)).alias(f"__{j}_{n}") for j in "be" for n in names])
    rows = steps("start", "b").union(steps("end", "e")).union(asked.select("chrom", "pos", *none))
    at = rows.groupBy("chrom", "pos").agg(*[typed(F.sum(f"__{k}_{n}"), n).alias(f"__{k}_{n}") for k in "be" for n in names])
    w = Window.partitionBy("chrom").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = at.select("chrom", "pos", *[typed(F.sum(f"__b_{n}").over(w) - F.col(f"__b_{n}"), n).alias(f"__b_{n}") for n in names], *[typed(F.sum(f"__e_{n}").over(w), n).alias(f"__e_{n}") for n in names])
    side = lambda k, c: run.select("chrom", F.col("pos").alias(c), *[f"__{k}_{n}" for n in names])
    out = queries.join(side("b", "end"), ["chrom", "end"], "left").join(side("e", "start"), ["chrom", "start"], "left")
    met = lambda n: F.when(F.col("end") > F.col("start"), F.col(f"__b_{n}") - F.col(f"__e_{n}"))
    return out.select(*[F.col(f"`{c}`") for c in queries.columns], *[typed(met(n), n).alias(n) for n in names])


def subset_matrix(regions: DataFrame, files: DataFrame, names: list[str], fraction: bool = False) -> DataFrame:
    """For each region a column for each name in files.name: 1 if an interval of that name overlaps, else 0.

    fraction: the largest share of the region that one of them covers.
    """
    keys = regions.select("chrom", "start", "end").distinct()
    if not fraction:
        hits = met_sums(keys, files, **{f"__n{i}": F.when(F.col("name") == n, 1) for i, n in enumerate(names)})
        return hits.select("chrom", "start", "end", *[(F.col(f"__n{i}") > 0).cast("int").alias(n) for i, n in enumerate(names)])
    pairs = overlap_join(keys, files)
    share = overlap_length(F.col("q_start"), F.col("q_end"), F.col("t_start"), F.col("t_end")) / (F.col("q_end") - F.col("q_start"))
    found = pairs.groupBy("q_chrom", "q_start", "q_end").agg(*[F.max(F.when(F.col("t_name") == n, share)).alias(n) for n in names])
    joined = keys.join(found, (keys["chrom"] == found["q_chrom"]) & (keys["start"] == found["q_start"]) & (keys["end"] == found["q_end"]), "left")
    return joined.select(keys["chrom"], keys["start"], keys["end"], *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: share of a's rows that b hits, of b's rows that a hits, and their mean."""
    hit = lambda x, y: overlapping(x, y).agg(F.count("*").alias("n"))
    rows = hit(a, b).select(F.col("n").alias("ha")).crossJoin(a.agg(F.count("*").alias("na"))).crossJoin(hit(b, a).select(F.col("n").alias("hb"))).crossJoin(b.agg(F.count("*").alias("nb")))
    return rows.select((F.col("ha") / F.col("na")).alias("a_hit"), (F.col("hb") / F.col("nb")).alias("b_hit"), ((F.col("ha") / F.col("na") + F.col("hb") / F.col("nb")) / 2).alias("mean_hit"))
