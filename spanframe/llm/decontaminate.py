"""Benchmark decontamination: a prefix-filtered join of document windows with benchmark windows.

A benchmark item becomes windows of ``window`` consecutive words (one shorter window where the item has
fewer words). A window counts as contained in a document where all its words stand there consecutively,
that is at containment 1: of the window's shingles, ordered by rarity over all documents, a prefix of one
suffices, because a document that holds the window holds its rarest shingle too. So

1. the document frequency of each benchmark shingle is counted over all documents,
2. each window is filed under its rarest shingle, with the shingle's place in the window,
3. a document's shingles are looked up; each hit fixes where the window must begin,
4. the length and positional bounds drop hits whose window would leave the document,
5. the words at that place are compared with the window's, first by hash and then byte by byte.

The index of windows is broadcast in the function's closure in blocks of at most ``block_windows`` windows;
a larger benchmark is worked off block by block against all documents, and the blocks' hits are merged per
row. The join is row-local, so no key can be hot; one document's rows never meet another's.

Defined results: null or empty text has no words and no hits; a null item text has no windows; a null
item_id marks words but is no item id; repeated items and rows each keep their own results; an empty
benchmark leaves every row clean; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm import _text
from spanframe.llm._text import U, fresh, map_texts, own_columns, split_words
from spanframe.scratch import Scratch

WINDOW = 10
SHINGLE = 3
#: A window costs about 200 bytes in the index.
BLOCK_WINDOWS = 200_000


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows of lower-cased words with the items that hold them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.filter(F.split(F.translate("text", upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))
    return (
        items.select("item_id", words.alias("words"))
        .where(n > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.least(n, F.lit(window))), " "))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("items"))
    )


@dataclass
class _Block:
    """Windows by number: their words, hash, and the items that hold them."""

    texts: list[str]
    items: list[list]
    width: np.ndarray
    hashes: np.ndarray
    shingles: list[np.ndarray]  # of each window, by place


def _block(rows: list) -> _Block:
    texts = [r["window"] for r in rows]
    words = split_words(pa.array(texts, pa.string()), "alnum", False)
    width = np.diff(words.first)
    hashes, shingles = np.zeros(len(texts), np.uint64), [np.zeros(0, np.uint64)] * len(texts)
    for k in np.unique(width):
        all_k, s = words.windows(int(k))[0], words.windows(min(SHINGLE, int(k)))[0]
        for i in np.flatnonzero(width == k):
            a, b = words.first[i], words.first[i + 1]
            hashes[i], shingles[i] = all_k[a], s[a : b - min(SHINGLE, int(k)) + 1]
    return _Block(texts, [sorted(r["items"], key=str) for r in rows], width, hashes, shingles)


def _shingles(words: _text.Words, k: int) -> np.ndarray:
    """Hash of the shingle that starts at each word; of those that leave their text, a value in no index."""
    out = np.zeros(len(words.hash), np.uint64)
    h, ok = words.windows(k)
    out[: len(h)] = np.where(ok, h, U(0))
    return out


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Most values are in no window: a bit for each 18-bit prefix dismisses them before the search.
    seen = np.zeros(1 << 18, bool)
    seen[(table >> U(46)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values >> U(46)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    hit = table[at] == values[maybe]
    return maybe[hit], at[hit]


def _frequencies(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """Number of places of each wanted shingle, by width and hash, over all documents."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column(0), "alnum", True)
        ks, hs, ns = [], [], []
        for k, table in wanted.items():
            _, at = _find(table, _shingles(words, k))
            which, n = np.unique(at, return_counts=True)
            ks.append(np.full(len(which), k, np.int32)), hs.append(table[which].view(np.int64)), ns.append(n.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ks, hs, ns)], ["k", "h", "n"])

    counted = map_texts(docs.select("text"), "text", "k int, h long, n long", count).groupBy("k", "h").agg(F.sum("n").alias("n"))
    # At most a row for each shingle of the block.
    return {(r["k"], int(np.int64(r["h"]).view(np.uint64))): r["n"] for r in counted.collect()}


def _index(block: _Block, docs: DataFrame):
    """Postings by shingle width: sorted shingle hashes, and for each the windows filed under it."""
    width = np.minimum(block.width, SHINGLE)
    wanted = {int(k): np.unique(np.concatenate([s for s, w in zip(block.shingles, width, strict=True) if w == k])) for k in np.unique(width)}
    often = _frequencies(docs, wanted)
    filed: dict[int, list[tuple[int, int, int]]] = {}
    for i, (s, k) in enumerate(zip(block.shingles, width, strict=True)):
        rank = [(often.get((int(k), int(h)), 0), int(h)) for h in s]
        place = min(range(len(s)), key=rank.__getitem__)
        filed.setdefault(int(k), []).append((int(s[place]), i, place))
    out = {}
    for k, rows in filed.items():
        rows.sort()
        h = np.array([r[0] for r in rows], np.uint64)
        table, first = np.unique(h, return_index=True)
        out[k] = table, np.append(first, len(h)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return out


def _hits(part: pa.RecordBatch, block: _Block, index) -> tuple[_text.Words, np.ndarray, np.ndarray]:
    """The words of a slice, and first word and window number of each verified occurrence."""
    words = split_words(part.column(part.schema.get_field_index("text")), "alnum", True)
    last = np.repeat(words.first[1:], np.diff(words.first))
    first = np.repeat(words.first[:-1], np.diff(words.first))
    begins, numbers = [], []
    for k, (table, bounds, window, place) in index.items():
        at, which = _find(table, _shingles(words, k))
        n = bounds[which + 1] - bounds[which]
        at, post = np.repeat(at, n), np.repeat(bounds[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        number, begin = window[post], at - place[post]
        inside = (begin >= first[at]) & (begin + block.width[number] <= last[at])
        begin, number = begin[inside], number[inside]
        for w in np.unique(block.width[number]):
            own = block.width[number] == w
            h, _ = words.windows(int(w))
            same = h[begin[own]] == block.hashes[number[own]]
            begins.append(begin[own][same]), numbers.append(number[own][same])
    begin = np.concatenate(begins or [np.zeros(0, np.int64)])
    number = np.concatenate(numbers or [np.zeros(0, np.int64)])
    exact = np.ones(len(begin), bool)
    for i, (b, w) in enumerate(zip(begin, number, strict=True)):
        said = b" ".join(words.word(j) for j in range(b, b + block.width[w]))
        exact[i] = said.translate(_LOWER) == block.texts[w].encode()
    return words, begin[exact], number[exact]


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


ADDED = ("__n_words", "__spans", "__items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, names: tuple[str, ...] = ADDED) -> DataFrame:
    """docs (with a column text) and, added to each row, n_words, spans and items.

    spans: [begin, end) word ranges of all window occurrences, merged; items: ids of the items with a window
    that occurs, distinct, sorted as strings. Their names are ADDED, or what the caller gives; docs must not have them.

    The windows are worked off in blocks, one at a time: what a block has found is written before the next is read.
    """
    windows = _item_windows(benchmark.select("item_id", "text"), window)
    ids = T.ArrayType(benchmark.schema["item_id"].dataType)
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    out, scratch = docs, Scratch(docs.sparkSession, "decontaminate")
    for b in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        out = _mark(out, docs, _block(own.collect()), ids, b == 0, names)
        if b < blocks - 1:
            out = scratch.keep(out, f"block-{b}")
            if b:
                scratch.drop(f"block-{b - 1}")
    return out


def _mark(out: DataFrame, docs: DataFrame, block: _Block, ids: T.ArrayType, first: bool, names: tuple[str, ...]) -> DataFrame:
    index = _index(block, docs) if block.texts else {}
    kinds = (T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), ids)
    added = [T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)]
    schema = T.StructType([*out.schema.fields, *added]) if first else out.schema
    width = len(out.columns) - (0 if first else len(added))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words, begin, number = _hits(part, block, index)
        doc = np.searchsorted(words.first, begin, side="right") - 1
        spans: list[list[list[int]]] = [[] for _ in range(part.num_rows)]
        items: list[set] = [set() for _ in range(part.num_rows)]
        if not first:
            spans = part.column(width + 1).to_pylist()
            items = [set(x) for x in part.column(width + 2).to_pylist()]
        for d in np.unique(doc):
            mine = doc == d
            found = [[int(a), int(a + block.width[w])] for a, w in zip(begin[mine] - words.first[d], number[mine], strict=True)]
            spans[d] = _merged(spans[d] + found)
            items[d].update(i for w in set(number[mine].tolist()) for i in block.items[w])
        cols = [pa.array(np.diff(words.first).astype(np.int64)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x, key=str) for x in items])]
        cols[2] = cols[2].cast(_arrow(ids))
        return pa.RecordBatch.from_arrays([*part.columns[:width], *cols], names=schema.names)

    return map_texts(out, "text", schema, run)


def _arrow(ids: T.ArrayType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.list_(to_arrow_type(ids.elementType))


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join(F.transform("__items", lambda i: i.cast("string")), ","), 256).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of any benchmark item, with their own columns."""
    names = fresh(docs, "n_words", "spans", "items")
    found = find_contamination(docs, benchmark, window, names=tuple(names))
    return found.where(F.size(names[1]) == 0).select(*own_columns(docs))
