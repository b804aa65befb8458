"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at a few text measures and votes good (1), bad (0) or abstains. How often rules are right is
not known in advance: expectation-maximisation over the counts of all vote patterns in the corpus estimates
how each rule votes, or abstains, on good and on bad texts, and the share of good texts. A document's posterior
probability of being good then replaces the usual demand that every rule pass.

The corpus is aggregated to its vote patterns before anything leaves the executors: there are at most
3 ** len(RULES) of them. The posterior is a column expression over the votes.

Defined results: null and empty texts have zero measures, fail the base rules and are not kept; repeated
rows repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]"
KEEP_FROM = 0.5
ROUNDS = 200
LEAST_BAD = 0.02
#: What rules say on good and on bad texts (good vote, bad vote, none) before anything is counted, and the share of
#: the corpus that this weighs as much as. Bad texts are of several kinds, of which a rule sees some only; without the
#: weight the one kind that most rules see would become the bad class, and the others good.
BELIEVED = ((0.6, 0.15, 0.25), (0.15, 0.6, 0.25))
BELIEF = 0.05
_OUTCOME = {1: 0, 0: 1, None: 2}

#: Name, condition for a good vote, condition for a bad one; neither: the rule abstains.
RULES = (
    ("length", "n_words >= 30", "n_words < 10"),
    ("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    ("symbols", "20 * n_symbols <= n_words", "5 * n_symbols >= n_words"),
    ("lines", "n_dup_lines = 0", "4 * n_dup_lines >= n_lines and n_dup_lines > 0"),
    ("repeats", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
    ("capitals", "4 * n_capitals <= n_letters", "2 * n_capitals > n_letters"),
    ("letters", "10 * n_letters >= 9 * word_chars", "20 * n_letters < 17 * word_chars"),
    ("function_words", "20 * n_function >= n_words", "n_words >= 20 and 50 * n_function < n_words"),
    ("line_ends", "10 * n_line_ends >= 9 * n_lines", "4 * n_line_ends < 3 * n_lines"),
)
#: Common function words of several languages, as they stand in running text.
FUNCTION_WORDS = (
    "the of and to in is that it for was on with as by at be this are or from an not but which "
    "der die das und ist von zu den mit nicht ein eine für auf im des dem sich "
    "de la le et les des un une dans est que pour qui sur au par il en du pas "
    "el los las una y por con para del se lo su no es al "
    "di che e il per non si da sono della "
    "o a os as um uma do não com"
).split()
LINE_ENDS = tuple(".!?:;\"')]…”»。！？")


def ranked(hashes: str) -> Column:
    """Structs of each hash h of an array and its place i, in order: equal hashes are neighbours."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated(ranks: str) -> Column:
    """The places, in order, of the hashes that a ranked array holds more than once."""
    near = lambda i, h: F.coalesce(F.get(ranks, i)["h"] == h, F.lit(False))
    return F.sort_array(F.transform(F.filter(ranks, lambda t, i: near(i - 1, t["h"]) | near(i + 1, t["h"])), lambda t: t["i"]))


def add_measures(docs: DataFrame) -> DataFrame:
    """docs with the measures of each text under their own names; docs must not have columns of these names.

    Windows of five words are compared by hash. All of it stays in one row; texts without equal windows skip it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__text", text).withColumn("__words", F.filter(F.split("__text", f"{SPACE}+"), lambda w: w != ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    said = sorted({*FUNCTION_WORDS, *(w.capitalize() for w in FUNCTION_WORDS)})
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[word(i + j) for j in range(5)]))
    rows = rows.withColumn("__lines", lines).withColumn("__h", F.when(n >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    counted = {
        "n_words": n.cast("long"),
        "word_chars": (F.length("__text") - F.regexp_count("__text", F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_capitals": F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long"),
        "n_letters": F.regexp_count("__text", F.lit(r"\p{L}")).cast("long"),
        "n_function": F.size(F.filter("__words", lambda w: w.isin(said))).cast("long"),
        "n_line_ends": F.size(F.filter("__lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(*LINE_ENDS))).cast("long"),
        "__again": F.size(F.array_distinct("__h")) < F.size("__h"),
    }
    rows = rows.withColumns(counted)
    rows = rows.withColumn("__ranked", F.when(F.col("__again"), ranked("__h"))).withColumn("__starts", repeated("__ranked"))
    covered = F.aggregate(F.transform("__starts", lambda s, i: F.least(F.lit(5), F.coalesce(F.get("__starts", i + 1) - s, F.lit(5)))), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return rows.drop("__text", "__words", "__lines", "__h", "__again", "__ranked", "__starts")


def votes() -> list[Column]:
    """For each rule 1, 0 or null."""
    return [F.when(F.expr(good), 1).when(F.expr(bad), 0) for _, good, bad in RULES]


class VoteModel:
    """prior: share of good texts; said: of each rule, P(good vote), P(bad vote) and P(none), on good texts and on bad ones."""

    def __init__(self, prior: float, said: list[tuple[tuple[float, ...], tuple[float, ...]]]):
        self.prior, self.said = prior, said

    @classmethod
    def fit(cls, patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> "VoteModel":
        """Expectation-maximisation over (votes, number of texts); starts from rules that are right 8 times in 10.

        A rule may abstain more often on one kind of text than on the other, so that counts as well. Bad texts are
        taken to be at least LEAST_BAD of all: else the good kind could take them in where few rules speak.
        """
        model = cls(0.7, [BELIEVED] * len(RULES))
        belief = 1 + BELIEF * sum(n for _, n in patterns)
        for _ in range(rounds):
            good = total = 0.0
            seen = [tuple([belief * x for x in kind] for kind in BELIEVED) for _ in RULES]
            for vote, n in patterns:
                p = model.posterior(vote)
                good, total = good + n * p, total + n
                for (on_good, on_bad), v in zip(seen, vote, strict=True):
                    at = _OUTCOME[v]
                    on_good[at] += n * p
                    on_bad[at] += n * (1 - p)
            share = lambda x: tuple(y / sum(x) for y in x)
            model = cls(min(1 - LEAST_BAD, max(0.01, (good + 1) / (total + 2))), [(share(g), share(b)) for g, b in seen])
        return model

    def accuracies(self) -> list[tuple[float, float]]:
        """Of each rule, how often a vote is right on good texts, and on bad ones."""
        return [(g[0] / (g[0] + g[1]), b[1] / (b[0] + b[1])) for g, b in self.said]

    def _weights(self) -> list[tuple[float, float, float]]:
        """Log odds that a good vote, a bad one and none of each rule add.

        A good vote never speaks for a bad text, nor a bad one for a good text, and none weighs no more than either.
        This keeps good and bad from changing places.
        """
        out = []
        for g, b in self.said:
            for_good, for_bad, none = (log(x / y) for x, y in zip(g, b, strict=True))
            for_good, for_bad = max(0.0, for_good), min(0.0, for_bad)
            out.append((for_good, for_bad, min(for_good, max(for_bad, none))))
        return out

    def posterior(self, vote: tuple[int | None, ...]) -> float:
        odds = log(self.prior / (1 - self.prior)) + sum(w[_OUTCOME[v]] for w, v in zip(self._weights(), vote, strict=True))
        return 1 / (1 + exp(-odds))

    def column(self) -> Column:
        odds = F.lit(log(self.prior / (1 - self.prior)))
        for v, (good, bad, none) in zip(votes(), self._weights(), strict=True):
            odds = odds + F.when(v == 1, F.lit(good)).when(v == 0, F.lit(bad)).otherwise(F.lit(none))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_votes(measured: DataFrame) -> VoteModel:
    """Fits on all rows; the driver receives the counts of vote patterns, 3 ** len(RULES) at most."""
    names = [f"v{i}" for i in range(len(RULES))]
    counts = measured.select(*[v.alias(a) for v, a in zip(votes(), names, strict=True)]).groupBy(*names).agg(F.count("*").alias("n"))
    rows = sorted(((tuple(r[a] for a in names), r["n"]) for r in counts.collect()), key=lambda x: [-1 if v is None else v for v in x[0]])
    return VoteModel.fit(rows)


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and posterior for each row of docs."""
    # Measured once: the fit and the result read a few numbers for each row.
    measured = Scratch(docs.sparkSession, "quality-rules").keep(add_measures(docs.select("doc_id", "text")).drop("text"), "measures")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("posterior", fit_votes(measured).column())
    kept = ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM)
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
