"""MinHash near-duplicates with tensored banding.

A document's set holds the hashes of its distinct k-word shingles. Two small collections of ``m`` half keys
each are computed, a half key being HALF minhashes; a table key joins one half key of the left with one of
the right collection, so m * m tables of 2 * HALF minhashes each cost 2 * HALF * m minhashes instead of
2 * HALF * m * m. A pair of similarity s meets in some table unless one collection misses it, with probability of
at most 2 * (1 - s ** HALF) ** m; ``m`` is the least that keeps this under MISS at the threshold.

The stages:

1. One row-local pass makes signatures; documents with the same set (a 128-bit digest and the size) fall
   into one class, of which the least doc_id stands for all. Exact copies cost nothing further.
2. Half keys that a single class has are dropped; only classes with a shared left and a shared right half
   key form table keys, and only classes that share a table go on.
3. Of the sets of these classes, the shingles that two or more hold are counted. A class shares ``s`` of its n at
   most with any other. A table's pivot is its cleanest class, with the largest s / n, as the text that others
   vary is. Each class is compared with one pivot, the cleanest of its tables' that it can be linked with.
4. What the pivots have left open is found by a rare-prefix join of the same classes. Shingles are ordered by
   how many sets hold them. A pair that shares ``a`` shingles, a = ceil(t / (1 + t) * (n + n')) at least, has its first
   common shingle at a place of n - a at most in one set and n' - a in the other. So each class lists its first places
   with the sizes of partners that they allow (``lo`` to ``hi``), and meets others at (shingle, size class). Before the
   classes meet, a place is dropped where all belong to one component, and a class there that no other component's
   class allows. Groups that the pivots have joined so cost one pass over their lists, however large.
5. Step 4 is done twice: first with one class of each component at each place, then, over the components that
   have grown from that, with all. The second time compares every pair left, so no link between classes that
   share tables with any others depends on chance.

All links are confirmed on the full sets. A pair's sets travel to its comparison; a pivot's only once for each
block of its partners. Nothing is collected but the counts that end the search for components.

Defined results: a document without words has an empty set, no links, and itself as component; a null
doc_id has a null component and is kept; rows that share a doc_id count as one node and get one component; where
their texts differ, links of the least doc_id of a set are found by its largest set only, so callers with such
rows must give each text an id of its own, as the pipeline does; repeated rows repeat in the result; other
columns are not read; doc_id may be of any type that can be ordered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm._text import U, lists, map_texts, mix, split_words
from spanframe.llm.components import components
from spanframe.scratch import Scratch

MISS = 1e-5
HALF = 3
BLOCK = 500
SHINGLE = 5
THRESHOLD = 0.8


def tables_side(percent: int) -> int:
    """Half keys in each collection."""
    s, m = percent / 100, 1
    while 2 * (1 - s**HALF) ** m > MISS:
        m += 1
    return m


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = split_words(texts, "space", True)
    h, _ = words.windows(k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            w = U(b - a)
            for x in words.hash[a:b]:
                w = mix(np.array([w], np.uint64) ^ x)[0]
            out.append(np.array([w], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _half_keys(values: np.ndarray, starts: np.ndarray, side: int, m: int) -> np.ndarray:
    """m columns of half keys, each of HALF minhashes, for the sets that begin at starts."""
    out = np.zeros((len(starts), m), np.uint64)
    for i in range(m):
        key = np.full(len(starts), U(side * m + i))
        for j in range(HALF):
            seed = int(mix(np.array([(side * 1000 + i) * HALF + j + 1], np.uint64))[0])
            key = mix(key + np.minimum.reduceat((values ^ U(seed >> 1)) * U(seed | 1), starts))
        out[:, i] = key
    return out


def signatures(docs: DataFrame, k: int, m: int) -> DataFrame:
    """For each row: doc_id, n (size of its set), digest (d1, d2), and half keys, the left m first."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(1), k)
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        halves = np.zeros((0, 2 * m), np.uint64)
        if len(full):
            values = np.concatenate(sets)
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            d1[full] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), starts)
            d2[full] = np.add.reduceat(mix(values ^ U(0x14057B7EF767814F)), starts)
            halves = np.concatenate([_half_keys(values, starts, side, m) for side in (0, 1)], axis=1)
        counts = np.where(n > 0, 2 * m, 0)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(halves.reshape(-1).view(np.int64), counts, pa.int64())], ["doc_id", "n", "d1", "d2", "halves"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", f"doc_id {kind}, n long, d1 long, d2 long, halves array<long>", run)


def _table_keys(classes: DataFrame, m: int) -> DataFrame:
    """(key, rep) for the tables that classes may share."""
    halves = classes.select("rep", F.posexplode("halves").alias("at", "half"))
    shared = halves.groupBy("at", "half").agg(F.count("*").alias("c")).where("c > 1").select("at", "half")
    kept = halves.join(shared, ["at", "half"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("at", "half"))).alias("own"))  # 2m at most
    left = F.filter("own", lambda x: x["at"] < m)
    right = F.filter("own", lambda x: x["at"] >= m)
    keys = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.xxhash64(a["at"], a["half"], b["at"], b["half"]))))
    return kept.select("rep", F.explode(keys).alias("key"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold.

    Partners of one y go to blocks of BLOCK; each block gets y's set, then streams its partners' sets past it.
    """
    size = pairs.groupBy("y").agg(F.count("*").alias("c"))
    blocks = size.select("y", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "y").select("x", "y", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int").alias("block"))
    partners = dealt.join(sets.withColumnRenamed("rep", "x"), "x").select("y", "block", F.lit(1).alias("turn"), "x", "set")
    centres = blocks.join(sets.withColumnRenamed("rep", "y"), "y").select("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("turn"), F.col("y").alias("x"), "set")
    rows = centres.union(partners).repartition("y", "block").sortWithinPartitions("y", "block", "turn")

    def run(batches):
        centre, mine = None, None
        for batch in batches:
            ys, turns, xs, found = batch.column(0), batch.column(2).to_numpy(), batch.column(3), []
            raw = batch.column(4)
            for i in range(batch.num_rows):
                values = np.frombuffer(raw[i].as_buffer(), np.uint64)
                if turns[i] == 0:
                    centre, mine = ys[i].as_py(), values.copy()
                    continue
                if ys[i].as_py() != centre:
                    raise RuntimeError("a block of partners came without its pivot's set")
                at = np.searchsorted(mine, values)
                both = int(np.count_nonzero(mine[np.minimum(at, len(mine) - 1)] == values))
                if 100 * both >= percent * (len(mine) + len(values) - both):
                    found.append(i)
            if found:
                yield pa.RecordBatch.from_arrays([xs.take(pa.array(found)), ys.take(pa.array(found))], ["u", "v"])

    kind = pairs.schema["x"].dataType.simpleString()
    return rows.mapInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = int(100 * THRESHOLD)) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id and kept."""
    spark, m = docs.sparkSession, tables_side(percent)
    scratch = Scratch(spark, "minhash")
    signed = scratch.keep(signatures(docs, k, m), "signed")
    nodes = signed.where("n > 0 and doc_id is not null")
    classes = scratch.keep(nodes.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("halves").alias("halves")), "classes")
    # Classes that share a doc_id are one node of the graph; links to it are found by its largest set.
    single = classes.groupBy("rep").agg(F.max_by(F.struct("n", "halves"), F.struct("n", "d1", "d2")).alias("of")).select("rep", "of.n", "of.halves")
    single = scratch.keep(single, "single")
    keys = scratch.keep(_table_keys(single, m), "keys")
    tables = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    shared = scratch.keep(keys.join(tables, "key"), "shared")
    scratch.drop("keys")
    sets = scratch.keep(_sets(docs, shared.select("rep").distinct(), single, k), "sets")
    scratch.drop("single")
    scratch.free_shuffles()
    listed = scratch.keep(_listed(sets, percent), "listed")
    links = scratch.keep(_verified(_pivots(shared, listed, percent), sets, percent), "links-0")
    scratch.drop("shared")
    scratch.free_shuffles()
    found = components(links, scratch, "components-0")
    for at, whole in ((1, False), (2, True)):
        pairs = scratch.keep(_open_pairs(listed, found, percent, whole, scratch, f"open-{at}"), f"pairs-{at}")
        more = _verified(pairs, sets, percent)
        # Links between components join what their nodes already belong to.
        joined = found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)
        found = components(joined, scratch, f"components-{at}")
        scratch.free_shuffles()
    placed = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("c"))
    out = signed.select("doc_id", "n", "d1", "d2").join(placed, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sets(docs: DataFrame, involved: DataFrame, single: DataFrame, k: int) -> DataFrame:
    """(rep, set) of the involved nodes: the set as bytes of sorted hashes. Repeated rows repeat it.

    Of several texts under one doc_id the one that `single` describes counts.
    """
    wanted = involved.join(single.select("rep", "n"), "rep").withColumnRenamed("rep", "doc_id")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, x.tobytes()) for i, (x, n) in enumerate(zip(shingle_sets(part.column(1), k), part.column(2).to_pylist(), strict=True)) if len(x) == n]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([x for _, x in rows], pa.binary())], ["rep", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(texts, "text", f"rep {kind}, set binary", run)


def _listed(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, s, first): the size of each set, how many of its shingles others hold, and those in its first places.

    ``first`` is in the order of all lists, the shingles held by fewest sets first; the n - s that no other set
    holds come before. A set without shared shingles is left out.
    """
    kind = sets.schema["rep"].dataType.simpleString()

    def counted(batches):
        for batch in batches:
            found = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)])
            h, c = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                rep = batch.column(0).take(pa.array(np.full(len(h), i)))
                yield pa.RecordBatch.from_arrays([rep, pa.array(np.full(len(h), len(h))), pa.array(h)], ["rep", "n", "h"])

    held = sets.select("rep", "set").mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    each = sets.mapInArrow(spread, f"rep {kind}, n long, h long").join(held, "h")
    # One text's shared shingles are gathered, not one shingle's texts. Repeated rows count once.
    by_set = each.groupBy("rep", "n").agg(F.array_sort(F.collect_set(F.struct("c", "h"))).alias("all")).withColumn("s", F.size("all").cast("long"))
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    least = F.greatest(F.lit(0), places - (F.col("n") - F.col("s")))
    return by_set.select("rep", "n", "s", F.transform(F.slice("all", F.lit(1), least.cast("int")), lambda x: x["h"]).alias("first"))


def _may_link(percent: int, x: str, y: str) -> Column:
    """What both sizes and the shared shingles of each allow."""
    sizes = 100 * F.least(f"{x}n", f"{y}n") >= percent * F.greatest(f"{x}n", f"{y}n")
    return sizes & ((100 + percent) * F.least(f"{x}s", f"{y}s") >= percent * (F.col(f"{x}n") + F.col(f"{y}n")))


def _pivots(shared: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """(x, y): each class of a table and the cleanest pivot of its tables that it can be linked with."""
    ranked = shared.join(listed.select("rep", "n", "s"), "rep").withColumn("rank", F.struct(F.col("s") / F.col("n"), F.xxhash64("rep"), "rep"))
    best = ranked.groupBy("key").agg(F.max_by(F.struct("rep", "n", "s", "rank"), "rank").alias("p")).select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("rep", "n", "s", "rank")])
    fit = ranked.join(best, "key").where((F.col("rep") != F.col("p_rep")) & _may_link(percent, "", "p_"))
    return fit.groupBy(F.col("rep").alias("x")).agg(F.max_by("p_rep", "p_rank").alias("y"))


def _open_pairs(listed: DataFrame, found: DataFrame, percent: int, whole: bool, scratch: Scratch, name: str) -> DataFrame:
    """(x, y): pairs of classes of different components that can be linked; of the components of a place one class each, or all."""
    both, size_class = 100 + percent, lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    named = listed.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    placed = named.select("rep", "n", "s", "c", F.posexplode("first").alias("at", "h"))
    n, s, after = F.col("n"), F.col("s"), F.col("s") - F.col("at")
    # Sizes of partners that this place allows as the first common one: a = ceil(percent * (n + n') / both) shingles are left from here on in both.
    hi = F.floor(F.least(after, s) * both / percent).cast("long") - n
    entries = placed.select("rep", "n", "c", "h", F.ceil(n * percent / 100).cast("long").alias("lo"), hi.alias("hi")).where("hi >= lo")
    # The larger of two, or of equals the one of the larger id, seeks; the other one waits in its size class.
    seek = F.explode(F.sequence(size_class(F.col("lo")), size_class(F.least("hi", "n"))))
    waits = entries.select("h", size_class(n).alias("b"), "c", "rep", "n", "lo", "hi", F.lit(False).alias("seeks"))
    rows = waits.union(entries.select("h", seek.alias("b"), "c", "rep", "n", "lo", "hi", F.lit(True).alias("seeks")))
    rows = scratch.keep(rows, f"{name}-rows")
    waiting, seeking = F.when(~F.col("seeks"), F.col("hi")), F.when(F.col("seeks"), F.col("n"))
    per = scratch.keep(rows.groupBy("h", "b", "c").agg(F.max(waiting).alias("hi"), F.min(seeking).alias("n")), f"{name}-per")
    # The widest of those that wait and the smallest that seeks, and the same without these components.
    top = per.groupBy("h", "b").agg(F.max_by("c", "hi").alias("c_hi"), F.max("hi").alias("hi_1"), F.min_by("c", "n").alias("c_n"), F.min("n").alias("n_1"), F.count("*").alias("cs")).where("cs > 1 and hi_1 is not null and n_1 is not null")
    rest = per.join(top, ["h", "b"]).groupBy("h", "b").agg(F.max(F.when(F.col("c") != F.col("c_hi"), F.col("hi"))).alias("hi_2"), F.min(F.when(F.col("c") != F.col("c_n"), F.col("n"))).alias("n_2"))
    bounds = top.join(rest, ["h", "b"]).drop("cs")
    other_hi = F.when(F.col("c") == F.col("c_hi"), F.col("hi_2")).otherwise(F.col("hi_1"))
    other_n = F.when(F.col("c") == F.col("c_n"), F.col("n_2")).otherwise(F.col("n_1"))
    alive = rows.join(bounds, ["h", "b"]).where(F.when(F.col("seeks"), n <= other_hi).otherwise(F.col("hi") >= other_n))
    alive = scratch.keep(alive.select(*rows.columns), f"{name}-alive")
    a, b = alive.where("seeks").drop("seeks"), alive.where("not seeks").drop("seeks")
    if not whole:
        one = lambda df, rank: df.groupBy("h", "b", "c").agg(F.max_by(F.struct("rep", "n", "lo", "hi"), F.struct(rank, "rep")).alias("e")).select("h", "b", "c", "e.*")
        a, b = one(a, F.col("hi") - F.col("n")), one(b, F.col("hi"))
    a, b = (df.select("h", "b", *[F.col(c).alias(f"{side}_{c}") for c in ("c", "rep", "n", "lo", "hi")]) for df, side in ((a, "a"), (b, "b")))
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_rep") > F.col("b_rep")))
    allow = F.col("b_n").between(F.col("a_lo"), F.col("a_hi")) & (F.col("a_n") <= F.col("b_hi"))
    met = a.join(b, (a["h"] == b["h"]) & (a["b"] == b["b"]) & (F.col("a_c") != F.col("b_c")) & larger & allow)
    return met.select(F.col("a_rep").alias("x"), F.col("b_rep").alias("y")).distinct()
