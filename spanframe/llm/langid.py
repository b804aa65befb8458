"""Language ID with language-bitmask n-gram filters.

Fitting counts the letter trigrams of every labelled document, by language, over the whole training set. A
trigram, however rare, is filed under a language if its share of that language's trigrams is at least
``relative`` of its largest share in any language. The filed trigrams go into
bit-sliced Bloom filters: one array of cells whose bits are languages, so that a look-up of a trigram's
cells and one AND return all languages that hold it. A document is decided by the popcount of each language
over the document's trigrams, corrected by the filter's false-positive rate for that language. No language is
found if false positives explain the best one's count: one trigram that is held is enough in a text of four. A text
with letters of which that holds gets the learned language whose filter holds most, or else the one with most
training text, with score 0.

The model follows the distinct trigrams of letters, which grow much slower than the texts: the cells are sized
from the number filed by the language that files most. Training counts are aggregated before the shuffle (one
row for each language and trigram and slice) and the driver receives the filed trigrams only, as Arrow columns
of 12 bytes a trigram and language.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and every text if nothing could be
learned; a learned language for every other text; ties go to the language that sorts first; null
languages teach nothing; a null doc_id is not held out, and teaches nothing; repeated rows are judged alike;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm._text import U, fresh, map_texts, mix, own_columns

RELATIVE = 0.5
#: With HASHES this makes one false positive in 10,000 trigrams of the language that files most.
CELLS_PER_GRAM = 64
HASHES = 3
#: A count that false positives reach with at most this probability is evidence of a language.
CHANCE = 1e-3
UNKNOWN = "und"
#: Bytes of text in a slice: an array of 8 bytes a character stays small.
SLICE = 1 << 19
_CODES = 0x110000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    table = np.zeros(_CODES, np.uint32)
    for c in range(_CODES):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram values of all texts, the text of each, and whether each text has a letter.

    Runs of other characters than letters count as spaces; a text has one before and after it. Trigrams
    with a letter in the middle are kept.
    """
    said = [t or "" for t in texts.to_pylist()]
    n = np.array([len(t) for t in said])
    chars = _letters()[np.frombuffer(" ".join(["", *said, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    # chars: a space, then each text and a space
    owner = np.repeat(np.arange(len(said)), n + 1)
    middle = np.flatnonzero(chars[1:-1]) + 1
    c = chars.astype(np.uint64)
    grams = (c[middle - 1] << U(42)) | (c[middle] << U(21)) | c[middle + 1]
    doc = owner[middle - 1]
    has = np.zeros(len(said), bool)
    has[doc] = True
    return grams, doc, has


def _cells(grams: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(grams)
    return [((h >> U(20 * i)) & U(0xFFFFF)).astype(np.int64) % size if size <= 1 << 18 else (mix(h + U(i)) % U(size)).astype(np.int64) for i in range(HASHES)]


def _improbable(count: np.ndarray, total: np.ndarray, p: float) -> np.ndarray:
    """Minus the logarithm of Chernoff's bound on the probability of count or more hits of rate p in total."""
    n, p = np.maximum(total, 1), min(max(p, 1e-12), 1 - 1e-12)
    q = np.clip(count / n, p, 1)  # fewer hits than expected: 0
    return n * (q * np.log(q / p) + (1 - q) * np.log(np.maximum(1 - q, 1e-300) / (1 - p)))


@dataclass
class LanguageFilters:
    """languages: names by bit; cells: bit masks, up to 64 languages to a row; false_positives: rate by language."""

    languages: list[str]
    cells: np.ndarray
    false_positives: np.ndarray
    usual: int = 0  # the language with most training text

    @classmethod
    def build(cls, filed: dict[str, np.ndarray], totals: dict[str, int] | None = None) -> "LanguageFilters":
        names = sorted(filed)
        most = max((len(g) for g in filed.values()), default=1)
        size = max(1024, CELLS_PER_GRAM * most)
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(names) <= np.iinfo(k).bits), np.uint64)
        cells = np.zeros((-(-len(names) // 64) or 1, size), kind)
        rates = np.zeros(len(names))
        for bit, name in enumerate(names):
            row, mask = cells[bit // 64], kind(1 << (bit % 64))
            for at in _cells(filed[name], size):
                row[at] |= mask
            rates[bit] = np.mean((row & mask) != 0) ** HASHES
        usual = max(range(len(names)), key=lambda b: ((totals or {}).get(names[b], 0), -b), default=0)
        return cls(names, cells, rates, usual)

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """Bit masks of the languages whose filter holds each trigram."""
        first, *others = _cells(grams, self.cells.shape[1])
        out = self.cells[:, first]
        for at in others:
            out = out & self.cells[:, at]
        return out

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        grams, doc, has = _trigrams(texts)
        if not self.languages or not len(grams):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        held, total = self.holders(grams), np.bincount(doc, minlength=len(texts))
        share, odd = np.zeros((2, len(self.languages), len(texts)))
        for bit in range(len(self.languages)):
            count = np.bincount(doc, (held[bit // 64] >> U(bit % 64)) & U(1), len(texts))
            p = self.false_positives[bit]
            share[bit] = (count - p * total) / max(1e-9, 1 - p)
            odd[bit] = _improbable(count, total, p)
        share = np.clip(share / np.maximum(total, 1), 0, 1)
        top = share.max(0)
        best = np.where(top > 0, share.argmax(0), self.usual)
        sure = has & (top > 0) & (np.take_along_axis(odd, best[None], 0)[0] >= -np.log(CHANCE))
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(sure, top, 0.0)


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the key as text leaves the remainder fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_languages(train: DataFrame, relative: float = RELATIVE) -> LanguageFilters:
    """Fits on the columns text and lang of all rows of train whose lang is not null."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        grams, doc, _ = _trigrams(part.column(0))
        codes = part.column(1).dictionary_encode()
        lang = codes.indices.to_numpy()[doc]
        out = []
        for i, name in enumerate(codes.dictionary.to_pylist()):
            g, n = np.unique(grams[lang == i], return_counts=True)
            out.append(pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(b.num_rows for b in out) else None

    rows = train.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = map_texts(rows, "text", "lang string, gram long, n long", count, SLICE).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("found"))  # at most a row for each language
    from spanframe.scratch import Scratch

    kept = Scratch(train.sparkSession, "langid").keep(by_gram, "counts")
    per_row = kept.select("gram", F.explode("found").alias("f")).select("gram", "f.lang", "f.n")
    totals = {r["lang"]: r["total"] for r in per_row.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    if not totals:
        return LanguageFilters.build({})
    names = sorted(totals)
    known = F.create_map(*[F.lit(x) for at, k in enumerate(names) for x in (k, F.struct(F.lit(at).alias("at"), F.lit(totals[k]).alias("total")))])
    shares = F.transform("found", lambda f: F.struct(known[f["lang"]]["at"].alias("at"), (f["n"] / known[f["lang"]]["total"]).alias("share")))
    filed = (
        kept.select("gram", shares.alias("found"))
        .select("gram", F.array_max(F.transform("found", lambda f: f["share"])).alias("top"), F.explode("found").alias("f"))
        .where(F.col("f.share") >= relative * F.col("top"))
        .select("gram", "f.at")
        .toArrow()
    )
    grams, at = filed["gram"].to_numpy().view(np.uint64), filed["at"].to_numpy()
    return LanguageFilters.build({names[i]: grams[at == i] for i in np.unique(at)}, totals)


def add_language(docs: DataFrame, model: LanguageFilters, names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """docs with the language and its score under the given names, which docs must not have, for each row, from its text alone."""
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = model.judge(part.column(part.schema.get_field_index("text")))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=schema.names)

    return map_texts(docs, "text", schema, run, SLICE)


def keep_known(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """The rows of docs in whose text a language is found beyond chance, with their own columns."""
    lang, score = fresh(docs, "lang", "score")
    judged = add_language(docs, model, (lang, score))
    return judged.where((F.col(lang) != UNKNOWN) & (F.col(score) > 0)).select(*own_columns(docs))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the rows that are not held out."""
    out = held_out(F.col("doc_id"))
    known = docs.select("text", "lang", out.alias("o"), "doc_id").where(~F.col("o") & F.col("doc_id").isNotNull())
    model = fit_languages(known)
    return add_language(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
