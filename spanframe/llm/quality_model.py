"""Quality classifier: a sparse ensemble of rules.

Small trees are grown on random halves of the training rows by gradient boosting; every path from a root to
a node, a conjunction of thresholds on text statistics, becomes a rule. A logistic regression with an L1
penalty over all rules keeps few of them. The kept rules are compiled into one Spark column expression, so
scoring runs inside the engine; the statistics come from one row-local pass over the whole texts.

Training rows are bounded by MAX_TRAIN: of the labelled rows in the learning folds, those with the least
hash of doc_id are taken. Everything else covers all rows.

Defined results: an empty or null text has all statistics zero and is scored like any other; a null quality
teaches nothing; where several labels share a doc_id, each of its rows is judged alike and the labels'
mean, rounded half up, is learned; if nothing or one class can be learned every score is 0.5 or that
class's rate; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm._text import map_texts, split_words
from spanframe.llm.langid import held_out

MAX_TRAIN = 20_000
TREES = 24
DEPTH = 3
CUTS = 24
LEAST_ROWS = 20
PENALTY = 2e-3
RANGE = 6.0

STATISTICS = ("n_words", "word_length", "longest_word", "symbols", "digits", "capitals", "punctuation", "non_ascii", "distinct_words", "top_word", "repeated_pairs", "repeated_runs", "repeated_lines", "line_words", "symbol_words", "bare_lines")


def _share(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of true flags between consecutive bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds]).astype(float)


def _repeats(values: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: values, distinct ones, and the count of the most frequent."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    heads = np.flatnonzero(new)
    top = np.zeros(docs)
    np.maximum.at(top, d[heads], np.diff(np.append(heads, len(v))))
    return np.bincount(d, minlength=docs).astype(float), np.bincount(d[heads], minlength=docs).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    words = split_words(texts, "space", True)
    data, n_docs = words.data, len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.zeros(n_docs + 1, np.int64)
    np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), out=off[1:])
    kinds = np.zeros((6, 256), bool)
    kinds[0, list(b"#*$%&|<>{}[]~^=\\@_")] = True
    kinds[1, 48:58] = kinds[2, 65:91] = kinds[4, 128:] = True
    kinds[3, list(b".,;:!?\"'()-")] = True
    kinds[5, 65:91] = kinds[5, 97:123] = kinds[5, 128:] = True
    count = [_share(k[data], off) for k in kinds]
    n = np.diff(words.first).astype(float)
    one, doc = np.maximum(n, 1), words.doc
    length = (words.end - words.start).astype(float)
    chars = np.bincount(doc, length, n_docs)
    longest = np.zeros(n_docs)
    np.maximum.at(longest, doc, length)
    _, distinct, top = _repeats(words.hash, doc, n_docs)
    share = []
    for k in (2, 5):
        h, ok = words.windows(k)
        all_k, different, _ = _repeats(h[ok], doc[: len(h)][ok], n_docs)
        share.append((all_k - different) / np.maximum(all_k, 1))
    lines = [t.split("\n") for t in texts.to_pylist()]
    full = [[x for x in y if not x.isspace() and x] for y in lines]
    n_lines = np.array([len(x) for x in full], float)
    again = np.array([len(x) - len(set(x)) for x in full], float) / np.maximum(n_lines, 1)
    ends = np.array([sum(x.rstrip()[-1] not in ".!?:;\"'" for x in y) for y in full], float) / np.maximum(n_lines, 1)
    wordless = np.ones(len(words.start), bool)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds[5][data], out=letters[1:])
    wordless = letters[words.end] == letters[words.start]
    some = np.maximum(chars, 1)
    cols = [n, chars / one, longest, count[0] / one, count[1] / some, count[2] / np.maximum(count[5], 1), count[3] / one, count[4] / some, distinct / one, top / one, *share, again, n / np.maximum(n_lines, 1), np.bincount(doc, wordless, n_docs) / one, ends]
    return np.stack(cols, axis=1)


def add_statistics(docs: DataFrame) -> DataFrame:
    """docs with ``__stats``, a double for each of STATISTICS."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__stats", T.ArrayType(T.DoubleType()))])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(part.column(part.schema.get_field_index("text")))
        ends = pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1])
        return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(s.reshape(-1)))], names=schema.names)

    return map_texts(docs, "text", schema, run)


#: A rule: (statistic, threshold, above) conditions that all hold.
Rule = tuple[tuple[int, float, bool], ...]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, t, above in rule:
        out &= (x[:, f] > t) == above
    return out


def _grow(x: np.ndarray, r: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, rule: Rule, out: list[tuple[Rule, float]]) -> None:
    """Splits rows where the squared error of r falls most; each node but the root becomes a rule with its mean."""
    if rule:
        out.append((rule, float(r[rows].mean())))
    if depth == 0 or len(rows) < 2 * LEAST_ROWS:
        return
    best = (1e-9, None)
    total, n = r[rows].sum(), len(rows)
    for f, own in enumerate(cuts):
        if not len(own):
            continue
        bin_ = np.searchsorted(own, x[rows, f], side="left")  # values over own[k] come in bins above k
        count = np.cumsum(np.bincount(bin_, minlength=len(own) + 1))[:-1]
        low = np.cumsum(np.bincount(bin_, r[rows], len(own) + 1))[:-1]
        ok = (count >= LEAST_ROWS) & (n - count >= LEAST_ROWS)
        gain = np.where(ok, low**2 / np.maximum(count, 1) + (total - low) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (f, float(own[k])))
    if best[1] is None:
        return
    f, t = best[1]
    above = x[rows, f] > t
    for side in (False, True):
        _grow(x, r, rows[above == side], cuts, depth - 1, (*rule, (f, t, side)), out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    n, k = z.shape
    step = 4.0 / max(1.0, np.linalg.norm(z, 2) ** 2 / n + 1)
    w = v = np.zeros(k)
    b = c = 0.0
    t = 1.0
    for _ in range(600):
        e = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        new = v - step * (z.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * e.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return b, w


class RuleEnsemble:
    """bias, and (rule, weight) of the rules kept."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "RuleEnsemble":
        if not len(y):
            return cls(0.0, [])
        rate = (y.sum() + 0.5) / (len(y) + 1)
        prior = float(np.log(rate / (1 - rate)))
        if y.min() == y.max():
            return cls(prior, [])
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS), method="lower")) for f in range(x.shape[1])]
        rng, score, rules = np.random.default_rng(seed), np.full(len(y), prior), {}
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            rows = np.flatnonzero(rng.random(len(y)) < 0.5)
            grown: list[tuple[Rule, float]] = []
            if len(rows):
                _grow(x, y - p, rows, cuts, DEPTH, (), grown)
            for rule, mean in grown:
                rules[rule] = None
                if len(rule) == DEPTH:
                    score += 0.5 * mean / 0.25 * _holds(rule, x)
            score = np.clip(score, -8, 8)
        names, columns, seen = [], [], set()
        for rule in rules:
            z = _holds(rule, x)
            mark = z.tobytes()
            if 0 < z.mean() < 1 and mark not in seen:
                seen.add(mark)
                names.append(rule), columns.append(z)
        if not names:
            return cls(prior, [])
        bias, w = _lasso(np.stack(columns, axis=1).astype(float), y, PENALTY)
        return cls(bias, [(r, float(v)) for r, v in zip(names, w, strict=True) if abs(v) > 1e-6])

    def column(self, stats: Column) -> Column:
        """Score between 0 and 1 as an expression over the array of STATISTICS."""
        score = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, t, above in rule:
                holds = holds & ((stats[f] > t) if above else (stats[f] <= t))
            score = score + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        score = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most max_train rows of the learning folds (crc32 of doc_id mod 3 is not 1)."""
    marked = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    marked = marked.groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("y"))
    taken = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # max_train pairs of numbers at most
    found = add_statistics(rows).select("y", "__stats").collect()
    return np.array([r["__stats"] for r in found]).reshape(len(found), len(STATISTICS)), np.array([r["y"] for r in found])


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> RuleEnsemble:
    x, y = training_rows(docs, labels, max_train)
    order = np.lexsort([*x.T, y])  # the same model whatever order the rows come in
    return RuleEnsemble.fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = fit_quality(docs, labels, max_train)
    scored = add_statistics(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), model.column(F.col("__stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
