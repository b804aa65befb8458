"""Vectorised word splitting and hashing over Arrow string columns.

Texts stay UTF-8 bytes. Both word classes used here are separated by ASCII characters only, so a byte
mask finds their bounds. A word's hash is a polynomial over its bytes taken from one running sum, so a
slice costs a fixed number of numpy passes whatever its number of words.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(None)
def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * U(0x632BE59BD9B4E019))
    if lower:
        v[65:91] = v[97:123]
    return v


@lru_cache(None)
def _separators(kind: str) -> np.ndarray:
    """``alnum``: every ASCII byte but letters and digits separates; ``space``: ASCII white space does."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[[32, 9, 10, 11, 12, 13]] = True
    else:
        sep[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            sep[a:b] = False
    return sep


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES + (SLICE_BYTES >> 2)), base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 4 * SLICE_BYTES:  # longer ones go with their text
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """The words of a slice of texts: byte bounds, hashes, and the range of words of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # words of text i: first[i] to first[i + 1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and whether the run lies in one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.full(n, U(k))
        for j in range(k):
            h = h * _STEP + self.hash[j : n + j]
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return mix(h), np.arange(n) + k <= last

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of each; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def split_words(texts: pa.Array, kind: str, lower: bool) -> Words:
    data, off = utf8(texts)
    n = len(data)
    inside = ~_separators(kind)[data]
    bound = np.zeros(n + 1, bool)
    bound[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (bound[:n] | ~before))
    end = np.flatnonzero(inside & (bound[1:] | ~after)) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * _power(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(pow(_BASE, -1, 1 << 64), n)[start]
    h = mix(h + (end - start).astype(np.uint64) * _STEP)
    return Words(data, start, end, h, np.searchsorted(start, off))


def word_hashes(text: str, kind: str, lower: bool) -> np.ndarray:
    return split_words(pa.array([text]), kind, lower).hash


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name from each stem that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = f"__{stem}", 0
        while name.lower() in taken:
            name, k = f"__{stem}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts stay within most bytes, or hold one text."""
    if batch.num_rows == 0:
        return
    _, off = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: What Python workers keep between tasks beyond small tables: the module that keeps it, and how to let it go.
held: dict[str, Callable[[], None]] = {}


def let_go(owner: str) -> None:
    """Frees what other modules than owner keep in this worker, which serves one operator after another."""
    others = [held.pop(name) for name in list(held) if name != owner]
    for free in others:
        free()
    if others:
        gc.collect()


def map_texts(df: DataFrame, text: str, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = SLICE_BYTES) -> DataFrame:
    """Applies fn to bounded slices of df's rows. Row-local: no shuffle, and a lost task is run again."""

    def run(batches):
        let_go(fn.__module__)
        for batch in batches:
            for part in slices(batch, text, most):
                made = fn(part)
                if made is not None and made.num_rows:
                    yield made

    # Spark itself cannot look up names with dots here; slices carry others in their place.
    safe = [c if c.replace("_", "").isalnum() else f"__plain_{i}" for i, c in enumerate(df.columns)]
    return (df if safe == df.columns else df.toDF(*safe)).mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: the next counts[i] values go to row i."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
