"""Substring dedup with a log-structured fingerprint index.

A word is removed if it lies in a window of ``window`` words that also starts earlier: in a document with a
smaller id, or further to the front of the same one.

Every window is filed under its minimizer, the least hash among its runs of ``GRAM`` words (the leftmost of
equals). Windows of one minimizer that follow each other form a zone; equal windows always have equal
minimizers at equal places, so only zones with one fingerprint ``fp`` can share a window, and an index row
for each zone, about a seventh of the windows, loses none.

The index is a list of immutable runs, tables that are bucketed and sorted by ``fp``; a run holds, for each
distinct zone text ``ctx``, its first occurrence. ``append`` takes a new batch and

1. computes its zones; those that occur again within a slice of texts are marked at once, so that one
   passage in very many documents reaches the shuffle as a row for each slice,
2. deals the rest by ``fp`` and merge-joins it with each historical run,
3. marks the zones whose whole text is known, and records as suspects the new and historical zones that
   share a fingerprint but differ in text,
4. writes the new zones as a run, and compacts the runs into one when there are ``fanout`` of them.

``remove`` verifies the suspects: their windows are hashed from the texts themselves (128 bits) and a window
is marked if an earlier one is equal. Then the marked words are cut from the texts.

Zones count as equal if fingerprint and text hash, 128 bits, agree. Batches must come in the order that
"earlier" means. Nothing is collected to the driver.

Defined results: a null text has no words; a text shorter than a window loses nothing; a null doc_id is
never earlier than anything and loses nothing; rows that share a doc_id are one document, and what is
marked in one is cut from all, equal places not being earlier than each other; other columns are not read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm._text import U, _power, map_texts, mix, split_words
from spanframe.scratch import Scratch

WINDOW = 20
GRAM = 8
FANOUT = 2
#: Bytes of text in a slice: what recurs within one is summed up before the shuffle.
SLICE = 3 << 20
_CTX = 0xC2B2AE3D27D4EB4F | 1


class Zones:
    """The zones of a slice: text number, first window (word from the text's start), windows, hashes."""

    def __init__(self, words, window: int):
        self.words = words
        grams, _ = words.windows(GRAM)
        n = len(words.hash) - window + 1
        last = np.repeat(words.first[1:], np.diff(words.first))
        empty = np.zeros(0, np.int64)
        self.doc = self.begin = self.count = empty
        self.fp = self.ctx = np.zeros(0, np.uint64)
        if n <= 0:
            return
        at = np.arange(len(grams), dtype=np.uint64)
        # Ordered by 40 bits of hash, then by place.
        key = (grams >> U(24) << U(24)) | (at & U(0xFFFFFF))
        low, width, span = key, 1, window - GRAM + 1
        while 2 * width <= span:
            low, width = np.minimum(low[: len(low) - width], low[width:]), 2 * width
        low = np.minimum(low[:n], low[span - width : span - width + n])
        ok = np.arange(n) + window <= last[:n]
        starts = np.flatnonzero(ok)
        if not len(starts):
            return
        place = (low[starts] & U(0xFFFFFF)).astype(np.int64)
        if len(grams) > 1 << 24:  # places are known up to 2 ** 24
            place += (starts - place + (1 << 24) - 1) >> 24 << 24
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        a, m = starts[heads], place[heads]
        self.count = np.diff(np.append(heads, len(starts)))
        self.doc = np.searchsorted(words.first, a, side="right") - 1
        self.begin = a - words.first[self.doc]
        self.fp = grams[m]
        sums = np.zeros(len(words.hash) + 1, np.uint64)
        np.cumsum(words.hash * _power(_CTX, len(words.hash)), out=sums[1:])
        whole = (sums[a + self.count + window - 1] - sums[a]) * _power(pow(_CTX, -1, 1 << 64), len(words.hash))[a]
        self.ctx = mix(whole ^ mix((self.count * 64 + m - a).astype(np.uint64)))


def _zone_rows(docs: DataFrame, window: int) -> DataFrame:
    """Rows (mark, fp, ctx, doc_id, begin, count): zones to index, or window ranges known to be repeats."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        z = Zones(split_words(part.column(1), "space", False), window)
        if not len(z.fp):
            return None
        doc = ids[z.doc]
        order = np.lexsort((z.begin, doc, z.ctx, z.fp))
        fp, ctx, doc, begin, count = z.fp[order], z.ctx[order], doc[order], z.begin[order], z.count[order]
        first = np.ones(len(fp), bool)
        first[1:] = (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = (doc != doc[lead]) | (begin != begin[lead])
        # Repeats: join ranges of windows that touch.
        by = np.lexsort((begin[again], doc[again]))
        d, b, e = doc[again][by], begin[again][by], (begin + count)[again][by]
        head = np.ones(len(d), bool)
        head[1:] = (d[1:] != d[:-1]) | (b[1:] > e[:-1])
        h = np.flatnonzero(head)
        ends = np.maximum.reduceat(e, h) if len(h) else e
        mark = np.concatenate([np.zeros(first.sum(), bool), np.ones(len(h), bool)])
        none = np.zeros(len(h), np.int64)
        cols = [mark, np.concatenate([fp[first].view(np.int64), none]), np.concatenate([ctx[first].view(np.int64), none]), np.concatenate([doc[first], d[h]]), np.concatenate([begin[first], b[h]]), np.concatenate([count[first], ends - b[h]])]
        return pa.RecordBatch.from_arrays([pa.array(c, part.schema.field(0).type if i == 3 else None) for i, c in enumerate(cols)], ["mark", "fp", "ctx", "doc_id", "begin", "count"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    return map_texts(rows, "text", f"mark boolean, fp long, ctx long, doc_id {kind}, begin long, count long", run, SLICE)


@contextmanager
def _partial_keys(spark: SparkSession):
    """Lets tables bucketed by fp join on (fp, ctx) without a shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass(frozen=True)
class _Run:
    """A bucketed table; raw if it still holds rows that repeat others."""

    table: str
    folder: str
    raw: bool


class FingerprintIndex:
    """Runs of zones in the shared folder; see the module's text."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.window, self.fanout = spark, window, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "fingerprints")
        self.runs: list[_Run] = []
        self.marks: list[DataFrame] = []
        self.suspects: list[DataFrame] = []
        self._made = 0

    def _write(self, df: DataFrame, raw: bool) -> _Run:
        self._made += 1
        run = _Run(f"spanframe_run_{uuid.uuid4().hex}", f"run-{self._made}", raw)
        df.write.bucketBy(self.buckets, "fp").sortBy("fp", "ctx").option("path", f"{self.scratch.root}/{run.folder}").saveAsTable(run.table)
        return run

    def _read(self, run: _Run) -> DataFrame:
        """The first occurrence of each zone text that was new with the run."""
        rows = self.spark.table(run.table)
        if not run.raw:
            return rows
        return rows.where("not dup").select("fp", "ctx", "doc_id", "begin", "count").dropDuplicates(["fp", "ctx"])

    def close(self) -> None:
        """Deletes all runs."""
        for run in self.runs:
            self.spark.sql(f"drop table {run.table}")
            self.scratch.drop(run.folder)
        self.runs = []

    def append(self, batch: DataFrame) -> None:
        """Indexes a batch of documents (doc_id, text) and notes its repeats of itself and of history."""
        n = len(self.marks)
        rows = self.scratch.keep(_zone_rows(batch, self.window), f"zones-{n}")
        same = Window.partitionBy("fp", "ctx")
        new = rows.where("not mark").drop("mark").repartition(self.buckets, "fp")
        new = new.withColumn("first", F.min(F.struct("doc_id", "begin")).over(same))
        new = new.withColumn("dup", F.struct("doc_id", "begin") > F.col("first")).drop("first")
        new = new.withColumn("old", F.lit(0).cast("long"))
        for run in self.runs:
            held = self._read(run).select("fp", "ctx", F.lit(True).alias("held")).hint("merge")
            sizes = self._read(run).groupBy("fp").agg(F.count("*").alias("texts")).hint("merge")
            new = new.join(held, ["fp", "ctx"], "left").join(sizes, "fp", "left")
            new = new.withColumn("dup", F.col("dup") | F.coalesce("held", F.lit(False))).withColumn("old", F.col("old") + F.coalesce("texts", F.lit(0))).drop("held", "texts")
        new = new.withColumn("fresh", F.sum(F.when(~F.col("dup"), 1).otherwise(0)).over(Window.partitionBy("fp")))
        with _partial_keys(self.spark):
            made = self._write(new, raw=True)
            self.scratch.free_shuffles()
            run = self.spark.table(made.table)
            repeats = run.where("dup").select("doc_id", "begin", "count")
            self.marks.append(self.scratch.keep(rows.where("mark").select("doc_id", "begin", "count").union(repeats), f"marks-{n}"))
            self.scratch.drop(f"zones-{n}")
            doubtful = run.where("not dup and fresh + old > 1").select("doc_id", "begin", "count")
            met = run.where("not dup and old > 0").select("fp").distinct().hint("merge")
            for old in self.runs:
                doubtful = doubtful.union(self._read(old).join(met, "fp", "left_semi").select("doc_id", "begin", "count"))
            self.suspects.append(self.scratch.keep(doubtful, f"suspects-{n}"))
        self.runs.append(made)
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one that holds the first occurrence of each zone text."""
        if len(self.runs) < 2:
            return
        merged = self._read(self.runs[0])
        for run in self.runs[1:]:
            both = merged.alias("a").join(self._read(run).hint("merge").alias("b"), ["fp", "ctx"], "full")
            older = F.col("b.doc_id").isNull() | (F.col("a.doc_id").isNotNull() & (F.struct("a.doc_id", "a.begin") <= F.struct("b.doc_id", "b.begin")))
            merged = both.select("fp", "ctx", *[F.when(older, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("doc_id", "begin", "count")])
        with _partial_keys(self.spark):
            made = self._write(merged, raw=False)
        self.close()
        self.runs = [made]
        self.scratch.free_shuffles()

    def _verified(self, docs: DataFrame) -> DataFrame:
        """Windows of suspect zones that an earlier window equals, as (doc_id, begin, count)."""
        window = self.window
        zones = reduce(DataFrame.union, self.suspects).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("begin", "count")).alias("zones"))
        texts = docs.select("doc_id", "text").join(zones, "doc_id")

        def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
            words = split_words(part.column(1), "space", False)
            zone = part.column(2)
            of = np.repeat(np.arange(part.num_rows), np.diff(zone.offsets.to_numpy()))
            flat = zone.flatten()
            begin, count = (flat.field(i).to_numpy() for i in (0, 1))
            h1, ok = words.windows(window)
            at = np.repeat(words.first[of] + begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            who = np.repeat(of, count)
            # Rows that share a doc_id may have other texts.
            good = at + window <= words.first[who + 1]
            at, who = at[good], who[good]
            if not len(at):
                return None
            h2 = mix(h1[at] ^ words.hash[at] + words.hash[at + window - 1] * U(_CTX))
            for j in range(window):
                h2 = (h2 ^ words.hash[at + j]) * U(_CTX)
            ids = part.column(0).take(pa.array(who))
            return pa.RecordBatch.from_arrays([pa.array(h1[at].view(np.int64)), pa.array(mix(h2).view(np.int64)), ids, pa.array(at - words.first[who])], ["h1", "h2", "doc_id", "begin"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        found = self.scratch.keep(map_texts(texts, "text", f"h1 long, h2 long, doc_id {kind}, begin long", run, SLICE), "windows")
        first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.max(F.struct("doc_id", "begin")).alias("last")).where("first < last").drop("last")
        self.scratch.free_shuffles()
        later = found.join(first, ["h1", "h2"]).where(F.struct("doc_id", "begin") > F.col("first"))
        return later.select("doc_id", "begin", F.lit(1).cast("long").alias("count"))

    def remove(self, docs: DataFrame) -> DataFrame:
        """For each row of docs: doc_id, n_words, n_removed and kept_text, its kept words joined by a space."""
        window = self.window
        marks = reduce(DataFrame.union, self.marks).union(self._verified(docs)) if self.marks else None
        rows = docs.select("doc_id", "text")
        if marks is None:
            joined = rows.withColumn("marks", F.lit(None).cast("array<struct<begin:bigint,count:bigint>>"))
        else:
            marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "count")).alias("marks"))
            joined = rows.join(marks, "doc_id", "left")

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            words = split_words(part.column(1), "space", False)
            zone = part.column(2)
            sizes = np.where(zone.is_valid(), np.diff(zone.offsets.to_numpy()), 0)
            of = np.repeat(np.arange(part.num_rows), sizes)
            flat = zone.flatten()
            begin, count = (flat.field(i).to_numpy() for i in (0, 1))
            cover = np.zeros(len(words.hash) + 1, np.int64)
            end = np.minimum(words.first[of] + begin + count + window - 1, words.first[of + 1])
            np.add.at(cover, np.minimum(words.first[of] + begin, end), 1)
            np.add.at(cover, end, -1)
            kept = np.cumsum(cover)[:-1] == 0
            removed = np.add.reduceat(np.append(~kept, False).astype(np.int64), np.minimum(words.first[:-1], len(kept))) * (np.diff(words.first) > 0)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.array(removed), _joined(words, kept)], ["doc_id", "n_words", "n_removed", "kept_text"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return map_texts(joined, "text", f"doc_id {kind}, n_words long, n_removed long, kept_text string", run, SLICE)


def _joined(words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end = words.start[kept], words.end[kept]
    doc = words.doc[kept]
    inner = np.zeros(len(start), bool)  # a kept word of the same text follows, so a separator stands at its end
    inner[:-1] = doc[1:] == doc[:-1]
    step = np.zeros(len(words.data) + 2, np.int8)
    step[start] += 1
    np.subtract.at(step, end + inner, 1)
    keep = np.cumsum(step)[: len(words.data)] > 0
    data = words.data.copy()
    data[end[inner]] = 32
    sizes = np.bincount(doc, end - start + inner, len(words.first) - 1).astype(np.int64)
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, batches: int = 3) -> DataFrame:
    """Runs all of docs through a new index, in batches by ranges of doc_id, and removes the repeats."""
    index = FingerprintIndex(docs.sparkSession, window)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = docs.select("doc_id", "text")
        batch = batch if low is None else batch.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        index.append(batch)
    index.close()
    return index.remove(docs)
