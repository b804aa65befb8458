"""URL filters: a trie over reversed host labels and path segments.

Rules say allow or block for a host with all its subdomains and for the paths that start with the rule's
path. All rules go into one trie: host labels from the right, then a turn into the path, then whole path
segments, then the rest of the last segment as a plain prefix. The longest fitting rule decides: most
characters of host and path together, then most host characters; of equal rules block wins. Urls that no
rule fits get the default verdict.

The trie is broadcast inside the function's closure. Its size is the rules' size, which is checked against
MAX_RULE_CHARS; more rules than that raise an error at plan time rather than fail on executors.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty
table gives an empty result; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of more characters than this are not broadcast but joined.
MAX_RULE_CHARS = 64 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """``com/en/`` is the host com and the path /en/."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


@dataclass
class _Node:
    below: dict[str, "_Node"] = field(default_factory=dict)
    path: "_Node | None" = None
    ends: dict[str, Rule] = field(default_factory=dict)  # by the prefix of the next segment
    sizes: set[int] = field(default_factory=set)  # of these prefixes


def _rank(rule: Rule) -> tuple[int, int, bool]:
    return len(rule.host) + len(rule.path), len(rule.host), rule.verdict == "block"


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.below.setdefault(label, _Node())
            node.path = node.path or _Node()
            node = node.path
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            node.ends[rest] = max(node.ends.get(rest, rule), rule, key=_rank)
            node.sizes.add(len(rest))

    def _fitting(self, host: str, path: str) -> Iterator[Rule]:
        node = self.root
        segments = path.split("/")
        labels = reversed(host.split("."))
        while node:
            at = node.path
            for segment in segments:
                if at is None:
                    break
                for size in at.sizes:
                    if size <= len(segment) and (rule := at.ends.get(segment[:size])):
                        yield rule
                at = at.below.get(segment)
            node = node.below.get(next(labels, None))

    def match(self, host: str, path: str) -> Rule | None:
        return max(self._fitting(host, path), key=_rank, default=None)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """JVM-side columns of the host, its A-Z lower-cased, and the path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules that are too many to broadcast, as a join on (host, whole path segments).

    The trie's paths become rows: each distinct url lists its host's suffixes with its path's leading segments, at most
    labels times segments, and meets the rules filed under them. Equal urls are judged once.
    """
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    n, k = F.size(labels), F.size(segments)
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, n - i + 1, i), ".")))
    starts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.array_join(F.slice(segments, 1, i), "/"))
    urls = rows.select("host", "path").distinct()
    asked = urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("h"), starts.alias("starts")).select("host", "path", "h", F.posexplode("starts").alias("depth", "whole"))
    own = F.split("p", "/")
    filed = rules.select("verdict", F.col("host").alias("h"), F.col("path").alias("p")).select("*", (F.size(own) - 1).alias("depth"), F.array_join(F.slice(own, 1, F.size(own) - 1), "/").alias("whole"))
    rank = F.struct(F.length("h") + F.length("p"), F.length("h"), (F.col("verdict") == "block"))
    met = asked.join(filed, ["h", "depth", "whole"]).where(F.startswith("path", "p"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), rank).alias("b"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", most: int = MAX_RULE_CHARS) -> DataFrame:
    """One row for each page: key, host, path, rule (null where none fits) and verdict.

    rules of up to most characters are broadcast as a trie; more of them, or a table of them (verdict, host, path), are
    joined, to the same result.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if sum(len(r.text) for r in rules) > most:
            rules = pages.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    if isinstance(rules, DataFrame):
        return _joined(rows, rules, default)
    trie = UrlTrie(rules)
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rule = pa.array([r and r.text for r in found], pa.string())
            verdict = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
