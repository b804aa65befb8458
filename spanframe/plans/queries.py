"""Registered queries of the interval, track, statistics and sequence operators over the driver's tables.

The tables have no genomic columns, so views derive intervals, positions and tracks from them; the SQL uses the
same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions import sequence as sq
from spanframe.operators import annotation, coverage, genomics, intervals, islands, pairs, regions, statistics
from spanframe.operators.alignment import align_columns
from spanframe.scratch import Scratch
from spanframe.sources import text_formats, writers
from spanframe.streaming import tracks

CHROMS = 997
DAY0 = "1992-01-01"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str, *keep: str, key: str = "l_partkey") -> DataFrame:
    """lineitem as intervals of days: from the ship date as long as the quantity."""
    df = _t(spark, d, "lineitem").withColumn("__s", F.datediff("l_shipdate", F.lit(DAY0).cast("date")))
    return intervals.as_intervals(df, F.col(key) % CHROMS, "__s", F.col("__s") + F.col("l_quantity").cast("int"), *keep)


def orders(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    df = _t(spark, d, "orders").withColumn("__s", F.datediff("o_orderdate", F.lit(DAY0).cast("date")))
    return intervals.as_intervals(df, F.col("o_custkey") % CHROMS, "__s", F.col("__s") + 1 + F.col("o_orderkey") % 30, *keep)


def track(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """events as a track: mean value by event type (or of one type, by user mod 10) and minute."""
    df = _t(spark, d, "events").withColumn("pos", F.expr("unix_micros(cast(ts as timestamp)) div 60000000"))
    if kind:
        return df.where(F.col("event_type") == kind).groupBy((F.col("user_id") % 10).cast("string").alias("chrom"), "pos").agg(F.round(F.avg("value"), 4).alias("value"))
    return df.groupBy(F.col("event_type").alias("chrom"), "pos").agg(F.round(F.avg("value"), 4).alias("value"))


_I = f"(SELECT CAST(l_partkey % {CHROMS} AS VARCHAR) AS chrom, date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS e, * FROM lineitem)"
_O = f"(SELECT CAST(o_custkey % {CHROMS} AS VARCHAR) AS chrom, date_diff('day', DATE '{DAY0}', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '{DAY0}', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS e, * FROM orders)"
_T = "(SELECT event_type AS chrom, epoch_us(ts) // 60000000 AS pos, round(avg(value), 4) AS value FROM events GROUP BY ALL)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a track with runs of consecutive positions: mean quantity by return flag and ship day."""
    day = F.datediff("l_shipdate", F.lit(DAY0).cast("date")).cast("long")
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("chrom"), day.alias("pos")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))


_DAILY = f"(SELECT l_returnflag AS chrom, date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) AS pos, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY ALL)"


def _kind(k: str) -> str:
    return f"(SELECT CAST(user_id % 10 AS VARCHAR) AS chrom, epoch_us(ts) // 60000000 AS pos, round(avg(value), 4) AS value FROM events WHERE event_type = '{k}' GROUP BY ALL)"


QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _sql_relation(relation: str) -> str:
    ends = {"a": "t.s", "b": "(t.e - 1)", "x": "q.s", "y": "(q.e - 1)"}
    return " ".join(ends.get(w, w) for w in intervals.RELATIONS[relation].split(" "))


def _relation(relation: str) -> None:
    if relation in ("lt", "gt"):
        # The pairs are quadratic, so they are counted by chromosome.
        register(f"interval_{relation}", f"SELECT q.chrom, count(*) AS pairs FROM {_I} q JOIN {_O} t ON q.chrom = t.chrom AND {_sql_relation(relation)} GROUP BY q.chrom")(
            lambda s, d: intervals.pairs_apart(items(s, d), orders(s, d), relation)
        )
        return
    register(f"interval_{relation}", f"SELECT l_orderkey, l_linenumber, o_orderkey FROM {_I} q JOIN {_O} t ON q.chrom = t.chrom AND {_sql_relation(relation)}")(
        lambda s, d: intervals.overlap_join(items(s, d, "l_orderkey", "l_linenumber"), orders(s, d, "o_orderkey"), relation).select(F.col("q_l_orderkey").alias("l_orderkey"), F.col("q_l_linenumber").alias("l_linenumber"), F.col("t_o_orderkey").alias("o_orderkey"))
    )


for _r in intervals.RELATIONS:
    _relation(_r)

_ANY = _sql_relation("any")


@register("interval_semi", f"SELECT l_orderkey, l_linenumber FROM {_I} q WHERE EXISTS (SELECT 1 FROM {_O} t WHERE q.chrom = t.chrom AND {_ANY})")
def interval_semi(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlapping(items(s, d, "l_orderkey", "l_linenumber"), orders(s, d)).select("l_orderkey", "l_linenumber")


@register("interval_anti", f"SELECT l_orderkey, l_linenumber FROM {_I} q WHERE NOT EXISTS (SELECT 1 FROM {_O} t WHERE q.chrom = t.chrom AND {_ANY})")
def interval_anti(s: SparkSession, d: str) -> DataFrame:
    return intervals.not_overlapping(items(s, d, "l_orderkey", "l_linenumber"), orders(s, d)).select("l_orderkey", "l_linenumber")


_SHARED = "(least(q.e, t.e) - greatest(q.s, t.s))"


@register("interval_threshold", f"SELECT l_orderkey, l_linenumber, o_orderkey FROM {_I} q JOIN {_O} t ON q.chrom = t.chrom AND {_ANY} AND {_SHARED} >= 0.5 * (q.e - q.s)")
def interval_threshold(s: SparkSession, d: str) -> DataFrame:
    pairs = intervals.overlap_join(items(s, d, "l_orderkey", "l_linenumber"), orders(s, d, "o_orderkey"), threshold=0.5)
    return pairs.select(F.col("q_l_orderkey").alias("l_orderkey"), F.col("q_l_linenumber").alias("l_linenumber"), F.col("t_o_orderkey").alias("o_orderkey"))


@register("interval_reciprocal", f"SELECT l_orderkey, l_linenumber, o_orderkey FROM {_I} q JOIN {_O} t ON q.chrom = t.chrom AND {_ANY} AND {_SHARED} >= 0.5 * (q.e - q.s) AND {_SHARED} >= 0.5 * (t.e - t.s)")
def interval_reciprocal(s: SparkSession, d: str) -> DataFrame:
    pairs = intervals.overlap_join(items(s, d, "l_orderkey", "l_linenumber"), orders(s, d, "o_orderkey"), reciprocal=0.5)
    return pairs.select(F.col("q_l_orderkey").alias("l_orderkey"), F.col("q_l_linenumber").alias("l_linenumber"), F.col("t_o_orderkey").alias("o_orderkey"))


@register("overlap_totals", f"SELECT count(*) AS pairs, CAST(sum({_SHARED}) AS BIGINT) AS shared FROM {_I} q JOIN {_O} t ON q.chrom = t.chrom AND {_ANY}")
def overlap_totals(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_totals(items(s, d), orders(s, d))


@register("similarity", f"WITH q AS {_I}, t AS {_O}, a AS (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM t WHERE q.chrom = t.chrom AND {_ANY}) THEN 1.0 ELSE 0.0 END) AS x FROM q), b AS (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM q WHERE q.chrom = t.chrom AND {_ANY}) THEN 1.0 ELSE 0.0 END) AS y FROM t) SELECT round(x, 9) AS a_hit, round(y, 9) AS b_hit, round((x + y) / 2, 9) AS mean_hit FROM a, b")
def similarity(s: SparkSession, d: str) -> DataFrame:
    return intervals.similarity(items(s, d), orders(s, d)).select(*[F.round(c, 9).alias(c) for c in ("a_hit", "b_hit", "mean_hit")])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("subset_matrix", f"SELECT q.chrom, CAST(q.s AS BIGINT) AS start, CAST(q.e AS BIGINT) AS \"end\", " + ", ".join(f"CAST(coalesce(max(CASE WHEN o_orderpriority = '{p}' THEN 1 END), 0) AS INT) AS p{p[0]}" for p in _PRIORITIES) + f" FROM (SELECT DISTINCT chrom, s, e FROM {_I}) q LEFT JOIN {_O} t ON q.chrom = t.chrom AND {_ANY} GROUP BY ALL")
def subset_matrix(s: SparkSession, d: str) -> DataFrame:
    files = orders(s, d, "o_orderpriority").withColumnRenamed("o_orderpriority", "name")
    out = intervals.subset_matrix(items(s, d), files, _PRIORITIES)
    return out.select("chrom", "start", "end", *[F.col(f"`{p}`").alias(f"p{p[0]}") for p in _PRIORITIES])


def _islands(pad: int = 0) -> str:
    return f"SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {pad} THEN 0 ELSE 1 END AS o FROM (SELECT CAST(o_custkey AS VARCHAR) AS chrom, s, e, o_totalprice, o_orderpriority FROM {_O}))"


def _by_customer(s: SparkSession, d: str) -> DataFrame:
    df = _t(s, d, "orders").withColumn("__s", F.datediff("o_orderdate", F.lit(DAY0).cast("date")))
    return intervals.as_intervals(df, F.col("o_custkey"), "__s", F.col("__s") + 1 + F.col("o_orderkey") % 30, "o_totalprice", "o_orderpriority")


_MERGED = 'chrom, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end"'


@register("merge_max", f"SELECT {_MERGED}, max(o_totalprice) AS score FROM ({_islands()}) GROUP BY chrom, island")
def merge_max(s: SparkSession, d: str) -> DataFrame:
    return islands.merge_intervals(_by_customer(s, d), F.max("o_totalprice").alias("score"))


@register("merge_sum", f"SELECT {_MERGED}, round(sum(o_totalprice), 2) AS score FROM ({_islands()}) GROUP BY chrom, island")
def merge_sum(s: SparkSession, d: str) -> DataFrame:
    return islands.merge_intervals(_by_customer(s, d), F.round(F.sum("o_totalprice"), 2).alias("score"))


@register("merge_pad", f"SELECT {_MERGED}, count(*) AS n FROM ({_islands(30)}) GROUP BY chrom, island")
def merge_pad(s: SparkSession, d: str) -> DataFrame:
    return islands.merge_intervals(_by_customer(s, d), F.count("*").alias("n"), pad=30)


@register("merge_names", f"SELECT {_MERGED}, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS names FROM ({_islands()}) GROUP BY chrom, island")
def merge_names(s: SparkSession, d: str) -> DataFrame:
    return islands.merge_intervals(_by_customer(s, d), islands.merged_names("o_orderpriority").alias("names"))


@register("gap_invert", f"WITH m AS (SELECT {_MERGED} FROM ({_islands()}) GROUP BY chrom, island), x AS (SELECT * FROM m UNION ALL SELECT DISTINCT chrom, 3000, 3000 FROM m) SELECT chrom, p AS start, start AS \"end\" FROM (SELECT chrom, start, CAST(coalesce(lag(\"end\") OVER (PARTITION BY chrom ORDER BY start, \"end\"), 0) AS BIGINT) AS p FROM x) WHERE start > p")
def gap_invert(s: SparkSession, d: str) -> DataFrame:
    df = _by_customer(s, d)
    return islands.invert(df, df.select("chrom").distinct().withColumn("size", F.lit(3000).cast("long")))


@register("self_overlap", f"SELECT coalesce(bool_or(s < p), false) AS self_overlapping FROM (SELECT s, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {_O})")
def self_overlap(s: SparkSession, d: str) -> DataFrame:
    return islands.self_overlaps(orders(s, d))


@register("peak_call", f"SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\", CAST(trunc(max(value)) AS BIGINT) AS score FROM (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS r FROM {_T} WHERE value >= 60) GROUP BY chrom, r")
def peak_call(s: SparkSession, d: str) -> DataFrame:
    return islands.peaks(track(s, d), 60.0)


@register("valley_call", f"SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\", CAST(trunc(min(value)) AS BIGINT) AS score FROM (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS r FROM {_T} WHERE value <= 20) GROUP BY chrom, r")
def valley_call(s: SparkSession, d: str) -> DataFrame:
    return islands.peaks(track(s, d), 20.0, minima=True)


_IP, _OP = f"(SELECT DISTINCT chrom, s AS pos FROM {_I})", f"(SELECT DISTINCT chrom, s AS pos FROM {_O})"


@register("nearest_order", f"SELECT q.chrom, CAST(q.pos AS BIGINT) AS pos, CAST(l.pos AS BIGINT) AS left_pos, CAST(r.pos AS BIGINT) AS right_pos, CAST(CASE WHEN r.pos IS NULL OR q.pos - l.pos <= r.pos - q.pos THEN l.pos ELSE r.pos END AS BIGINT) AS nearest_pos FROM {_IP} q ASOF LEFT JOIN {_OP} l ON q.chrom = l.chrom AND q.pos >= l.pos ASOF LEFT JOIN {_OP} r ON q.chrom = r.chrom AND q.pos <= r.pos")
def nearest_order(s: SparkSession, d: str) -> DataFrame:
    points = lambda df: df.select("chrom", F.col("start").alias("pos")).distinct()
    return islands.nearest(points(items(s, d)), points(orders(s, d)))


@register("min_distance", "WITH p AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS chrom, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS pos FROM orders) SELECT chrom, pos FROM (SELECT *, pos - lag(pos) OVER w AS b, lead(pos) OVER w - pos AS a FROM p WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE coalesce(b >= 90, true) AND coalesce(a >= 90, true)")
def min_distance(s: SparkSession, d: str) -> DataFrame:
    return islands.min_distance_filter(_by_customer(s, d).select("chrom", F.col("start").alias("pos")).distinct(), 90)


@register("assign_space", f"WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS chrom, CAST(s AS BIGINT) AS pos, min(o_orderpriority) AS name FROM {_O} GROUP BY ALL) SELECT chrom, coalesce((lag(pos) OVER w + pos) // 2 + 1, 0) AS start, coalesce((pos + lead(pos) OVER w) // 2 + 1, 3000) AS \"end\", name FROM f WINDOW w AS (PARTITION BY chrom ORDER BY pos)")
def assign_space(s: SparkSession, d: str) -> DataFrame:
    df = _by_customer(s, d)
    sizes = df.select("chrom").distinct().withColumn("size", F.lit(3000).cast("long"))
    return islands.assign_space(df.select("chrom", F.col("start").alias("pos"), F.col("o_orderpriority").alias("name")), sizes)


_DEPTH = f"(SELECT chrom, p, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS n, sum(d) OVER (PARTITION BY chrom ORDER BY p ROWS UNBOUNDED PRECEDING) AS depth FROM (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, s AS p, 1 AS d FROM {_I} UNION ALL SELECT chrom, e, -1 FROM {_I}) GROUP BY ALL))"


@register("coverage_hist", f"SELECT CAST(depth AS BIGINT) AS depth, CAST(sum(n - p) AS BIGINT) AS positions FROM {_DEPTH} WHERE depth > 0 GROUP BY depth")
def coverage_hist(s: SparkSession, d: str) -> DataFrame:
    return coverage.depth_histogram(items(s, d))


@register("window_coverage", f"SELECT chrom, CAST(w * 30 AS BIGINT) AS start, CAST(sum(least(e, (w + 1) * 30) - greatest(s, w * 30)) AS BIGINT) AS covered FROM (SELECT chrom, s, e, unnest(range(s // 30, (e - 1) // 30 + 1)) AS w FROM {_I}) GROUP BY ALL")
def window_coverage(s: SparkSession, d: str) -> DataFrame:
    df = items(s, d)
    return coverage.window_coverage(df, df.select("chrom").distinct(), 30)


@register("region_values", f"SELECT q.chrom, q.s AS start, q.e AS \"end\", round(min(value), 4) AS low, round(max(value), 4) AS high, round(avg(value), 6) AS mean, count(value) AS positions FROM (SELECT event_id AS id, event_type AS chrom, epoch_us(ts) // 60000000 + event_id % 3 AS s, epoch_us(ts) // 60000000 + 5 + event_id % 60 AS e FROM events) q LEFT JOIN {_T} t ON q.chrom = t.chrom AND t.pos >= q.s AND t.pos < q.e GROUP BY q.id, q.chrom, q.s, q.e")
def region_values(s: SparkSession, d: str) -> DataFrame:
    start = F.expr("unix_micros(cast(ts as timestamp)) div 60000000")
    found = coverage.region_values(intervals.as_intervals(_t(s, d, "events"), "event_type", start + F.col("event_id") % 3, start + 5 + F.col("event_id") % 60), track(s, d))
    return found.select("chrom", "start", "end", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("mean", 6).alias("mean"), "positions")


@register("track_smooth", f"SELECT chrom, f + 2 AS pos, round(v, 5) AS value FROM (SELECT chrom, pos, lag(pos, 4) OVER w AS f, avg(value) OVER (PARTITION BY chrom ORDER BY pos ROWS 4 PRECEDING) AS v FROM {_T} WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE pos - f = 4".replace(_T, _DAILY))
def track_smooth(s: SparkSession, d: str) -> DataFrame:
    return coverage.smooth(daily(s, d), 5).select("chrom", "pos", F.round("value", 5).alias("value"))


def _combined(op: str, sql: str) -> None:
    register(f"track_{op}", f"SELECT chrom, pos, round({sql}, 6) AS value FROM (SELECT chrom, pos, coalesce(a.value, 0.0) AS x, coalesce(b.value, 0.0) AS y FROM {_kind('click')} a FULL JOIN {_kind('view')} b USING (chrom, pos))")(
        lambda s, d: coverage.combine(track(s, d, "click"), track(s, d, "view"), op).select("chrom", "pos", F.round("value", 6).alias("value"))
    )


for _op, _sql in {"add": "x + y", "subtract": "x - y", "multiply": "x * y", "divide": "x / nullif(y, 0)", "max": "greatest(x, y)", "min": "least(x, y)"}.items():
    _combined(_op, _sql)


@register("track_pearson", f"SELECT round(corr(a.value, b.value), 9) AS r, count(*) AS positions FROM {_kind('click')} a JOIN {_kind('view')} b USING (chrom, pos)")
def track_pearson(s: SparkSession, d: str) -> DataFrame:
    return coverage.pearson(track(s, d, "click"), track(s, d, "view")).select(F.round("r", 9).alias("r"), "positions")


@register("track_histogram", f"SELECT CAST(trunc(value) AS BIGINT) AS bin, count(*) AS positions FROM {_T} GROUP BY bin")
def track_histogram(s: SparkSession, d: str) -> DataFrame:
    return coverage.value_histogram(track(s, d))


@register("track_clip", f"SELECT chrom, pos, least(greatest(value, 10.0), 80.0) AS value FROM {_T}")
def track_clip(s: SparkSession, d: str) -> DataFrame:
    return coverage.clip(track(s, d), 10.0, 80.0)


@register("track_stats", f"SELECT chrom, count(*) AS positions, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM {_T} GROUP BY chrom")
def track_stats(s: SparkSession, d: str) -> DataFrame:
    return coverage.track_stats(track(s, d)).select("chrom", "positions", "low", "high", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@register("coverage_ranges", f"SELECT chrom, CAST(p AS BIGINT) AS start, CAST(n AS BIGINT) AS \"end\", CAST(depth AS BIGINT) AS depth FROM {_DEPTH} WHERE depth > 0")
def coverage_ranges(s: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_segments(items(s, d))


_ROW = 'chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", l_orderkey, l_linenumber'


@register("bed_shear", f"SELECT chrom, CAST(s + k * 7 AS BIGINT) AS start, CAST(least(e, s + k * 7 + 7) AS BIGINT) AS \"end\", l_orderkey, l_linenumber, CAST(k AS INT) AS piece FROM (SELECT *, unnest(range(0, (e - s - 1) // 7 + 1)) AS k FROM {_I})")
def bed_shear(s: SparkSession, d: str) -> DataFrame:
    return regions.shear(items(s, d, "l_orderkey", "l_linenumber"), 7)


@register("bed_midpoint", f"SELECT chrom, CAST((s + e) // 2 AS BIGINT) AS start, CAST((s + e) // 2 + 1 AS BIGINT) AS \"end\", l_orderkey, l_linenumber FROM {_I}")
def bed_midpoint(s: SparkSession, d: str) -> DataFrame:
    return regions.midpoint(items(s, d, "l_orderkey", "l_linenumber"))


@register("bed_pad", f"SELECT chrom, CAST(greatest(0, s - 5) AS BIGINT) AS start, CAST(e + 9 AS BIGINT) AS \"end\", l_orderkey, l_linenumber FROM {_I}")
def bed_pad(s: SparkSession, d: str) -> DataFrame:
    return regions.pad(items(s, d, "l_orderkey", "l_linenumber"), 5, 9)


@register("bed_filter", f"SELECT {_ROW} FROM {_I} WHERE e - s BETWEEN 10 AND 40 AND s >= 500 AND e <= 2000")
def bed_filter(s: SparkSession, d: str) -> DataFrame:
    return regions.filter_regions(items(s, d, "l_orderkey", "l_linenumber"), min_length=10, max_length=40, min_start=500, max_end=2000)


@register("bed_unique", f'SELECT DISTINCT chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM {_I}')
def bed_unique(s: SparkSession, d: str) -> DataFrame:
    return regions.unique_regions(items(s, d))


@register("bed_sort", f"SELECT {_ROW} FROM {_I} ORDER BY ALL")
def bed_sort(s: SparkSession, d: str) -> DataFrame:
    return regions.coordinate_sort(items(s, d, "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@register("bed_distance_from_ends", f"SELECT {_ROW}, CAST(least(s, 3000 - e) AS BIGINT) AS score FROM {_I}")
def bed_distance_from_ends(s: SparkSession, d: str) -> DataFrame:
    df = items(s, d, "l_orderkey", "l_linenumber")
    return regions.distance_from_ends(df, df.select("chrom").distinct().withColumn("size", F.lit(3000).cast("long")))


def _math(op: str, sql: str) -> None:
    a = f"(SELECT chrom, s, e, l_extendedprice AS v FROM {_I})"
    b = f"(SELECT chrom, s, e, min(o_totalprice) AS w FROM {_O} GROUP BY ALL)"
    register(f"bed_math_{op}", f'SELECT chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", round({sql}, 4) AS value FROM {a} JOIN {b} USING (chrom, s, e)')(
        lambda s, d: regions.exact_math(items(s, d, "l_extendedprice").withColumnRenamed("l_extendedprice", "value"), orders(s, d, "o_totalprice").withColumnRenamed("o_totalprice", "value"), op).select("chrom", "start", "end", F.round("value", 4).alias("value"))
    )


for _op, _sql in {"plus": "v + w", "minus": "v - w", "times": "v * w", "divideBy": "v / nullif(w, 0)"}.items():
    _math(_op, _sql)


@register("fdr_by_rank", "SELECT p_partkey, p_size AS value, round(greatest(0.0, p_size - log10(t / r)), 9) AS fdr FROM (SELECT p_partkey, p_size, count(*) OVER (ORDER BY p_size DESC RANGE UNBOUNDED PRECEDING) * 1.0 AS r, count(*) OVER () AS t FROM part)")
def fdr_by_rank(s: SparkSession, d: str) -> DataFrame:
    return regions.fdr_by_rank(_t(s, d, "part").select("p_partkey", F.col("p_size").alias("value"))).select("p_partkey", "value", F.round("fdr", 9).alias("fdr"))


@register("n50_documents", "WITH x AS (SELECT n_chars, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id) AS c, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents), t AS (SELECT sum(n_chars) AS total, count(*) AS contigs, max(n_chars) AS largest FROM documents) SELECT CAST(total AS BIGINT) AS total, contigs, largest, n_chars AS n50, k AS l50 FROM x, t WHERE 2 * c >= total ORDER BY k LIMIT 1")
def n50_documents(s: SparkSession, d: str) -> DataFrame:
    return statistics.assembly_stats(_t(s, d, "documents").select(F.col("n_chars").alias("length")))


@register("bh_adjusted", "WITH x AS (SELECT event_id, round(value / 1000.0, 6) AS p FROM events), r AS (SELECT p, sum(count(*)) OVER (ORDER BY p) AS k, count(*) AS n FROM x GROUP BY p), m AS (SELECT count(*) AS m FROM x), q AS (SELECT p, least(1.0, min(p * m / k) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r, m) SELECT event_id, p, round(q, 9) AS q FROM x JOIN q USING (p)")
def bh_adjusted(s: SparkSession, d: str) -> DataFrame:
    return statistics.benjamini_hochberg(_t(s, d, "events").select("event_id", F.round(F.col("value") / 1000.0, 6).alias("p"))).select("event_id", "p", F.round("q", 9).alias("q"))


@register("spectrum", "WITH k AS (SELECT p_size AS derived, 60 AS total, count(*) AS sites FROM part WHERE p_size > 0 AND p_size < 60 GROUP BY p_size) SELECT derived, total, sites, round(sites / (SELECT sum(sites) FROM k), 9) AS share FROM k")
def spectrum(s: SparkSession, d: str) -> DataFrame:
    return statistics.frequency_spectrum(_t(s, d, "part").select(F.col("p_size").alias("derived"), F.lit(60).alias("total"))).select("derived", "total", "sites", F.round("share", 9).alias("share"))


@register("densest_interval", "WITH x AS (SELECT event_type AS chain, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT a.chain, a.value AS low, b.value AS high, row_number() OVER (PARTITION BY a.chain ORDER BY b.value - a.value, a.value, b.value) AS r FROM x a JOIN x b ON a.chain = b.chain AND b.i = a.i + greatest(1, CAST(ceil(0.95 * a.n) AS INT)) - 1), m AS (SELECT event_type AS chain, avg(value) AS mean FROM events GROUP BY ALL) SELECT chain, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM p JOIN m USING (chain) WHERE r = 1")
def densest_interval(s: SparkSession, d: str) -> DataFrame:
    return statistics.densest_interval(_t(s, d, "events").select(F.col("event_type").alias("chain"), "value")).select("chain", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@register("enrichment", f"WITH a AS {_I}, b AS {_O}, z AS (SELECT count(*) AS na, sum(e - s) AS bases FROM a), p AS (SELECT least(1.0, (bases + na * (e - s - 1)) / (1000000000.0 - (e - s) + 1)) AS p FROM b, z), t AS (SELECT count(*) AS elements, sum(p) AS expected, sum(p * (1 - p)) AS variance FROM p), h AS (SELECT count(*) AS hits FROM b q WHERE EXISTS (SELECT 1 FROM a t WHERE q.chrom = t.chrom AND {_ANY})) SELECT elements, hits, round(expected, 6) AS expected, round(variance, 6) AS variance, round(hits / expected, 6) AS enrichment, round((hits - expected) / sqrt(variance), 6) AS z FROM t, h")
def enrichment(s: SparkSession, d: str) -> DataFrame:
    out = statistics.overlap_enrichment(items(s, d), orders(s, d), 1_000_000_000)
    return out.select("elements", "hits", *[F.round(c, 6).alias(c) for c in ("expected", "variance", "enrichment", "z")])


@register("fisher")
def fisher(s: SparkSession, d: str) -> DataFrame:
    """Order status against priority by segment, tested one-sided."""
    joined = _t(s, d, "orders").join(_t(s, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    both = lambda x, y: F.count(F.when(x & y, 1))
    open_, urgent = F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "1-URGENT"
    tables = joined.groupBy("c_mktsegment").agg(both(open_, urgent).alias("a"), both(open_, ~urgent).alias("b"), both(~open_, urgent).alias("c"), both(~open_, ~urgent).alias("d"))
    return statistics.fisher_tests(tables)


@register("term_enrichment")
def term_enrichment(s: SparkSession, d: str) -> DataFrame:
    part = _t(s, d, "part")
    annotated = part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"))
    return statistics.term_enrichment(annotated, part.where("p_size > 40").select(F.col("p_partkey").alias("gene")))


_BASES = "regexp_replace(upper(p_name), '[^ACGT]', '', 'g')"


@register("gc_content", f"SELECT p_partkey, round(length(regexp_replace(s, '[AT]', '', 'g')) / nullif(CAST(length(s) AS DOUBLE), 0), 9) AS gc FROM (SELECT p_partkey, {_BASES} AS s FROM part)")
def gc_content(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", F.round(sq.gc_content(F.col("p_name")), 9).alias("gc"))


@register("reverse_complement", f"SELECT p_partkey, reverse(translate({_BASES}, 'ACGT', 'TGCA')) AS seq FROM part")
def reverse_complement(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", sq.reverse_complement(F.regexp_replace(F.upper("p_name"), "[^ACGT]", "")).alias("seq"))


@register("kmer_counts", f"SELECT kmer, count(*) AS n FROM (SELECT unnest([s[i:i + 2] FOR i IN range(1, length(s) - 1)]) AS kmer FROM (SELECT {_BASES} AS s FROM part) WHERE length(s) >= 3) GROUP BY kmer")
def kmer_counts(s: SparkSession, d: str) -> DataFrame:
    bases = F.regexp_replace(F.upper("p_name"), "[^ACGT]", "")
    return _t(s, d, "part").select(F.explode(sq.kmers(bases, 3)).alias("k")).groupBy("k.kmer").agg(F.count("*").alias("n"))


@register("distinct_sequences", "SELECT seq, array_to_string(list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))), '; ') AS names FROM (SELECT p_partkey, p_type AS seq FROM part) GROUP BY seq")
def distinct_sequences(s: SparkSession, d: str) -> DataFrame:
    return genomics.distinct_sequences(_t(s, d, "part").select(F.col("p_type").alias("seq"), F.col("p_partkey").cast("string").alias("name")))


_AT = "strpos('TCAG', s[i{}]) - 1"


@register("translate_codons", f"SELECT p_partkey, coalesce(array_to_string([substr('{sq.CODE}', 16 * ({_AT.format('')}) + 4 * ({_AT.format(' + 1')}) + {_AT.format(' + 2')} + 1, 1) FOR i IN range(1, length(s) - 1, 3)], ''), '') AS protein FROM (SELECT p_partkey, {_BASES} AS s FROM part)")
def translate_codons(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", sq.translate_codons(F.regexp_replace(F.upper("p_name"), "[^ACGT]", "")).alias("protein"))


@register("variant_sites", "WITH v AS (SELECT l_suppkey AS chrom, l_partkey AS pos, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n FROM lineitem) SELECT chrom, pos, l_orderkey, l_linenumber FROM v WHERE n = 1")
def variant_sites(s: SparkSession, d: str) -> DataFrame:
    df = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("pos"), "l_orderkey", "l_linenumber")
    return genomics.filter_variants(df, biallelic_sites=True)


@register("cell_gene_counts", f"WITH p AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS cell, min(o_orderpriority) AS gene, count(DISTINCT o_orderpriority) AS n FROM {_I} q JOIN {_O} t ON q.chrom = t.chrom AND {_ANY} GROUP BY ALL) SELECT cell, gene, count(*) AS reads FROM p WHERE n = 1 GROUP BY ALL")
def cell_gene_counts(s: SparkSession, d: str) -> DataFrame:
    reads = items(s, d, "l_orderkey", "l_linenumber", "l_returnflag").select("chrom", "start", "end", F.struct("l_orderkey", "l_linenumber").alias("read_id"), F.col("l_returnflag").alias("cell"))
    return genomics.cell_gene_counts(reads, orders(s, d, "o_orderpriority").withColumnRenamed("o_orderpriority", "gene"))


@register("time_windows", "SELECT event_type AS chrom, epoch_us(ts) // 300000000 AS bucket, round(avg(value), 6) AS value, count(*) AS n, max(value) AS high FROM events GROUP BY ALL")
def time_windows(s: SparkSession, d: str) -> DataFrame:
    found = tracks.windowed_track(_t(s, d, "events"))
    return found.select("chrom", F.expr("unix_micros(start) div 300000000").alias("bucket"), F.round("value", 6).alias("value"), "n", "high")


@register("user_sessions", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events), i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k")
def user_sessions(s: SparkSession, d: str) -> DataFrame:
    found = tracks.sessions(_t(s, d, "events"))
    return found.select("user_id", F.expr("unix_micros(start)").alias("start"), "n", F.round("total", 4).alias("total"))


def _paired(s: SparkSession, d: str) -> DataFrame:
    """Each order as a pair of feet: its own days, and a week that begins 100 days later."""
    o = orders(s, d, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), F.struct("chrom", "start", "end").alias("a"), F.struct("chrom", (F.col("start") + 100).alias("start"), (F.col("start") + 107).alias("end")).alias("b"))


_HIT_A = f"EXISTS (SELECT 1 FROM {_I} t WHERE t.chrom = q.chrom AND t.s < q.e AND t.e > q.s)"
_HIT_B = f"EXISTS (SELECT 1 FROM {_I} t WHERE t.chrom = q.chrom AND t.s < q.s + 107 AND t.e > q.s + 100)"


@register("bedpe_either", f"SELECT o_orderkey AS id FROM {_O} q WHERE {_HIT_A} OR {_HIT_B}")
def bedpe_either(s: SparkSession, d: str) -> DataFrame:
    return pairs.pairs_hit(_paired(s, d), items(s, d)).select("id")


@register("bedpe_both", f"SELECT o_orderkey AS id FROM {_O} q WHERE {_HIT_A} AND {_HIT_B}")
def bedpe_both(s: SparkSession, d: str) -> DataFrame:
    return pairs.pairs_hit(_paired(s, d), items(s, d), both=True).select("id")


@register("interval_contacts", f"SELECT chrom, CAST(s + 100 AS BIGINT) AS start, CAST(s + 107 AS BIGINT) AS \"end\" FROM {_O} q WHERE {_HIT_A} UNION ALL SELECT chrom, CAST(s AS BIGINT), CAST(e AS BIGINT) FROM {_O} q WHERE {_HIT_B}")
def interval_contacts(s: SparkSession, d: str) -> DataFrame:
    return pairs.contacts_of(_paired(s, d), items(s, d))


_MATRIX = [dict(zip("ACGT", x, strict=True)) for x in ((2.0, 0.5, 0.1, 0.0), (0.1, 1.5, 0.2, 0.3), (0.0, 0.4, 0.6, 1.8))]
_SCORE = " + ".join(f"CASE s[i + {j}] " + " ".join(f"WHEN '{b}' THEN {v}::DOUBLE" for b, v in column.items()) + " END" for j, column in enumerate(_MATRIX, 1))


@register("motif_hits", f"WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS name, {_BASES} AS s FROM part), b AS (SELECT name, '+' AS strand, s FROM f UNION ALL SELECT name, '-', reverse(translate(s, 'ACGT', 'TGCA')) FROM f), i AS (SELECT *, unnest(range(0, length(s) - 2)) AS i FROM b), h AS (SELECT *, {_SCORE} AS score FROM i) SELECT name, CAST(CASE strand WHEN '+' THEN i ELSE length(s) - i - 3 END AS INT) AS start, CAST(CASE strand WHEN '+' THEN i ELSE length(s) - i - 3 END + 3 AS INT) AS \"end\", strand, round(score, 6) AS score FROM h WHERE score >= 0.7 * 5.3")
def motif_hits(s: SparkSession, d: str) -> DataFrame:
    names = _t(s, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.regexp_replace(F.upper("p_name"), "[^ACGT]", "").alias("seq"))
    return pairs.motif_hits(names, _MATRIX, 0.7).withColumn("score", F.round("score", 6))


@register("global_alignment")
def global_alignment(s: SparkSession, d: str) -> DataFrame:
    """Each part's name against its type, as sequences of letters."""
    dealt = _t(s, d, "part").select("p_partkey", "p_name", "p_type").repartition(4 * s.sparkContext.defaultParallelism, "p_partkey")  # the file is small, the work is not
    return dealt.select("p_partkey", align_columns(F.col("p_name"), F.col("p_type")).alias("x")).select("p_partkey", "x.score", "x.cigar")


@register("sliding_coverage", f"WITH i AS {_I}, p AS (SELECT chrom, s AS p FROM i UNION SELECT chrom, e FROM i), x AS (SELECT chrom, p AS x FROM p UNION SELECT chrom, p - 30 FROM p) SELECT x.chrom, CAST(x AS BIGINT) AS x, CAST(sum(greatest(0, least(e, x + 30) - greatest(s, x))) AS BIGINT) AS covered FROM x JOIN i ON x.chrom = i.chrom WHERE x >= 0 AND x + 30 <= 3000 GROUP BY ALL")
def sliding_coverage(s: SparkSession, d: str) -> DataFrame:
    df = items(s, d)
    return coverage.sliding_coverage(df, df.select("chrom").distinct().withColumn("size", F.lit(3000).cast("long")), 30)


_PLACES = "(SELECT {id} AS name, k, {m} AS m, sum(length(part)) OVER (PARTITION BY {id} ORDER BY k) + (k - 1) * length({m}) AS p, n FROM (SELECT {id}, unnest(x) AS part, generate_subscripts(x, 1) AS k, len(x) AS n FROM (SELECT {id}, string_split({text}, {m}) AS x FROM {table})))"


@register("digest", f"SELECT CAST(name AS VARCHAR) AS name, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS \"end\" FROM (SELECT name, coalesce(lag(e) OVER (PARTITION BY name ORDER BY k), 0) AS a, e AS b FROM (SELECT name, k, CASE WHEN k < n THEN p + 1 ELSE p END AS e FROM {_PLACES.format(id='p_partkey', text='p_name', table='part', m=chr(39) + 'an' + chr(39))})) WHERE b > a")
def digest(s: SparkSession, d: str) -> DataFrame:
    return genomics.digest(_t(s, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("seq")), "an", 1)


_SITES = " UNION ALL ".join(f"SELECT name, p + {ahead} AS pos, {forward} AS f, '{primer}' AS primer FROM {_PLACES.format(id='doc_id', text='text', table='documents', m=chr(39) + motif + chr(39))} WHERE k < n" for primer, motif, ahead, forward in (("ac", "ac", 2, 1), ("ac", "gt", 0, 0), ("ta", "ta", 2, 1), ("ta", "ta", 0, 0)))


@register("amplicons", f"WITH s AS ({_SITES}), o AS (SELECT *, lead(pos) OVER w AS q, lead(f) OVER w AS g, lead(primer) OVER w AS r FROM s WINDOW w AS (PARTITION BY name ORDER BY pos, f, primer)) SELECT CAST(name AS VARCHAR) AS chrom, CAST(pos - 2 AS BIGINT) AS start, CAST(q + 2 AS BIGINT) AS \"end\", primer || '+' || r AS name FROM o WHERE f = 1 AND g = 0 AND q - pos + 4 <= 100")
def amplicons(s: SparkSession, d: str) -> DataFrame:
    """Products of two short primers on the texts of documents, as sequences of letters."""
    return annotation.amplicons(_t(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq")), ["ac", "ta"], 100)


@register("sequence_lookup", "SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(doc_id % 50 AS BIGINT) AS start, CAST(least(doc_id % 50 + 300, length(text)) AS BIGINT) AS \"end\", substr(text, CAST(doc_id % 50 + 1 AS BIGINT), 300) AS seq FROM documents WHERE length(text) > doc_id % 50")
def sequence_lookup(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    near = F.col("doc_id") % 50
    places = intervals.as_intervals(docs.where(F.length("text") > near), "doc_id", near, F.least(near + 300, F.length("text")))
    return annotation.lookup_sequences(places, docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq")), piece=128)


@register("canonical_transcripts", "WITH t AS (SELECT l_suppkey AS gene, l_orderkey AS transcript, CAST(coalesce(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INT) END), 0) AS BIGINT) AS cds_length, CAST(sum(CAST(l_quantity AS INT) + 3) AS BIGINT) AS cdna_length FROM lineitem GROUP BY ALL) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY gene ORDER BY cds_length DESC, cdna_length DESC, transcript) = 1")
def canonical_transcripts(s: SparkSession, d: str) -> DataFrame:
    """Order lines as exons of a supplier's orders; lines that were not returned are coding."""
    size = F.col("l_quantity").cast("int").cast("long")
    coding = F.when(F.col("l_returnflag") == "N", F.lit(0).cast("long"))
    exons = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_orderkey").alias("transcript"), F.lit(0).cast("long").alias("start"), (size + 3).alias("end"), coding.alias("cds_start"), (coding + size).alias("cds_end"))
    return annotation.canonical_transcripts(exons)


_FEET = "(SELECT *, s + 100 AS s2, s + 107 AS e2 FROM {} x)"
_TOUCH = "((({0} < t.e AND {1} > t.s) OR ({0} < t.e2 AND {1} > t.s2)))"


@register("bedpe_pairs", f"SELECT DISTINCT q.o_orderkey AS id, t.l_orderkey * 10 + t.l_linenumber AS other_id FROM {_FEET.format(_O)} q JOIN {_FEET.format(_I)} t ON q.chrom = t.chrom AND {_TOUCH.format('q.s', 'q.e')} AND {_TOUCH.format('q.s2', 'q.e2')}")
def bedpe_pairs(s: SparkSession, d: str) -> DataFrame:
    lines = items(s, d, "l_orderkey", "l_linenumber")
    others = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.struct("chrom", "start", "end").alias("a"), F.struct("chrom", (F.col("start") + 100).alias("start"), (F.col("start") + 107).alias("end")).alias("b"))
    return pairs.pairs_meeting(_paired(s, d), others)


def _variants(s: SparkSession, d: str) -> DataFrame:
    """Order lines as variants: bases by line number and order, quality by price, depth by quantity."""
    base = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    alts = F.array(base(F.col("l_orderkey")), base(F.col("l_partkey")))
    depth = F.create_map(F.lit("DP"), F.col("l_quantity").cast("int").cast("string"))
    return _t(s, d, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("chrom"), F.col("l_partkey").alias("pos"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), base(F.col("l_linenumber")).alias("ref"), F.when(F.col("l_tax") > 0.04, alts).otherwise(F.slice(alts, 1, 1)).alias("alts"), F.floor("l_extendedprice").cast("double").alias("qual"), F.when(F.col("l_returnflag") == "N", "PASS").otherwise("low").alias("filter"), depth.alias("info"), F.lit("GT").alias("format"), F.array(F.lit("0|1")).alias("samples"))


_V = "(SELECT CAST(l_suppkey % 10 AS VARCHAR) AS chrom, l_partkey AS pos, l_orderkey || '_' || l_linenumber AS id, substr('ACGT', CAST(l_linenumber % 4 + 1 AS BIGINT), 1) AS ref, substr('ACGT', CAST(l_orderkey % 4 + 1 AS BIGINT), 1) AS alt, substr('ACGT', CAST(l_partkey % 4 + 1 AS BIGINT), 1) AS alt2, l_tax > 0.04 AS two, floor(l_extendedprice) AS qual, l_returnflag = 'N' AS passed, CAST(l_quantity AS INT) AS depth FROM lineitem)"


@register("vcf_criteria", f"SELECT id, chrom, pos, ref, alt FROM {_V} WHERE pos >= 50 AND qual >= 20000 AND NOT two AND passed AND depth >= 10 AND ((ref IN ('A', 'T') AND alt IN ('C', 'G')) OR (ref IN ('C', 'G') AND alt IN ('A', 'T')))")
def vcf_criteria(s: SparkSession, d: str) -> DataFrame:
    tests = annotation.variant_tests(min_pos=50, min_qual=20000, biallelic=True, substitutions=True, passed=True, weak_or_strong="change", infos=["DP >= 10"], formats=["GT"])
    return genomics.filter_variants(_variants(s, d), *tests).select("id", "chrom", "pos", "ref", F.col("alts")[0].alias("alt"))


def _written(s: SparkSession, name: str) -> str:
    return f"{Scratch(s, 'written').root}/{name}"


@register("file_vcf", f"SELECT id, chrom, pos, ref, CASE WHEN two THEN alt || ',' || alt2 ELSE alt END AS alts, qual, CASE WHEN passed THEN 'PASS' ELSE 'low' END AS filter, CAST(depth AS VARCHAR) AS depth, 1 AS allele FROM {_V}")
def file_vcf(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.vcf")
    writers.write_vcf(_variants(s, d), path, ["one"])
    return text_formats.read_vcf(s, path).select("id", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), "qual", "filter", F.col("info")["DP"].alias("depth"), F.element_at("genotypes", 1)[1].alias("allele"))


@register("file_bed", f'SELECT chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", o_orderpriority AS name FROM {_O}')
def file_bed(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.bed")
    text_formats.write_bed(orders(s, d, "o_orderpriority").withColumnRenamed("o_orderpriority", "name"), path)
    return text_formats.read_bed(s, path).select("chrom", "start", "end", "name")


@register("file_bedpe", f'SELECT CAST(o_orderkey AS VARCHAR) AS name, chrom, CAST(s AS BIGINT) AS a_start, CAST(e + 0 AS BIGINT) AS a_end, CAST(s + 100 AS BIGINT) AS b_start, CAST(s + 107 AS BIGINT) AS b_end FROM {_O}')
def file_bedpe(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.bedpe")
    strand = F.lit(None).cast("string")
    feet = {side: F.col(side).withField("strand", strand) for side in "ab"}
    writers.write_bedpe(_paired(s, d).withColumns(feet).select("a", "b", F.col("id").alias("name"), F.lit(None).cast("double").alias("score")), path)
    return text_formats.read_bedpe(s, path).select("name", "a.chrom", F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), F.col("b.start").alias("b_start"), F.col("b.end").alias("b_end"))


@register("file_bedgraph", f'SELECT chrom, pos AS start, pos + 1 AS "end", value FROM {_T}')
def file_bedgraph(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.bedgraph")
    writers.write_bedgraph(track(s, d).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value"), path)
    return text_formats.read_bedgraph(s, path)


@register("file_wig", f"SELECT chrom, CAST(pos AS BIGINT) AS pos, value FROM {_DAILY}")
def file_wig(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.wig")
    writers.write_wig(daily(s, d), path)
    return text_formats.read_wig(s, path)


def _named(s: SparkSession, d: str) -> DataFrame:
    bases = F.regexp_replace(F.upper("p_name"), "[^ACGT]", "")
    return _t(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.repeat(bases, F.lit(9)).alias("seq")).where("seq <> ''")


_NAMED = f"(SELECT 'p' || p_partkey AS name, repeat({_BASES}, 9) AS seq FROM part WHERE {_BASES} <> '')"


@register("file_fasta", f"SELECT name, seq FROM {_NAMED}")
def file_fasta(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.fa")
    writers.write_fasta(_named(s, d), path)
    return text_formats.read_fasta(s, path)


@register("file_fastq", f"SELECT name, seq, repeat('I', length(seq)) AS qual FROM {_NAMED}")
def file_fastq(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.fq")
    writers.write_fastq(_named(s, d).withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), path)
    return text_formats.read_fastq(s, path)


@register("file_sam", f"SELECT name, 'c' AS chrom, CAST(6 AS BIGINT) AS start, CAST(6 + length(seq) AS BIGINT) AS \"end\", seq, '7' AS nm FROM {_NAMED}")
def file_sam(s: SparkSession, d: str) -> DataFrame:
    path = _written(s, "a.sam")
    fields = {"flag": F.lit(0), "chrom": F.lit("c"), "pos": F.lit(7), "mapq": F.lit(60), "cigar": F.concat(F.length("seq").cast("string"), F.lit("M")), "rnext": F.lit(None), "pnext": F.lit(0), "tlen": F.lit(0), "qual": F.lit("*"), "tags": F.create_map(F.lit("NM:i"), F.lit("7"))}
    writers.write_sam(_named(s, d).withColumnRenamed("name", "qname").withColumns(fields), path, ["@HD\tVN:1.6"])
    return text_formats.read_sam(s, path).select(F.col("qname").alias("name"), "chrom", "start", "end", "seq", F.col("tags")["NM:i"].alias("nm"))
