"""Secret scans with a battery of randomness tests, in DataFrame functions only.

Known forms (assignments, access keys, long hex) are found by pattern. Beyond them every run of 20 or more
key characters outside a known span is a candidate. Its encoding is inferred from the classes of characters
that it uses, and it is tested

- against chance: chi-squared of uniform symbol counts, the runs test about the mean, and the lag-1 serial
  correlation, joined by Fisher's method into the probability that a uniform string looks like this;
- against ordinary text: the probability that a string of ordinary symbol frequencies is as even as this,
  from the noncentral chi-squared distribution, whose noncentrality grows with the length.

A candidate is a secret if the first does not reject chance (from KEEP_CHANCE) and the second is a
discovery: false discoveries are controlled by the Benjamini-Hochberg rule at RATE within classes of length,
so that many short candidates cannot buy short discoveries. The rule needs the counts of probabilities over
the whole corpus; they are aggregated to BINS bins for each class of length before they reach the driver.

Spans are [start, end) in code points. Defined results: a null or empty text has no spans; repeated rows
repeat; an empty table gives an empty result; other columns are not read by the report and kept by
``redact_secrets``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm._text import own_columns
from spanframe.scratch import Scratch

#: Kind, pattern, least length, and whether that counts the pattern's second group or the match.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    ("access", r"AKIA[A-Z0-9]+", 20, False),
    ("hex", r"[0-9a-f]+", 24, False),
)
RANDOM = "random"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_="
RATE = 0.01
KEEP_CHANCE = 1e-3
BINS = 80
CHUNK = 512
#: Chance that two symbols of ordinary text are equal, for digits and for letters.
DIGIT_COINCIDENCE, LETTER_COINCIDENCE = 0.15, 0.065
LENGTHS = (20, 24, 32, 48, 64, 128, 1 << 30)
MASK = "[SECRET]"


def _hints(text: Column) -> list[Column]:
    """Where one of these does not hold, the pattern of that rank has no match that is long enough."""
    # The look-ahead passes over most places with one test.
    words = r"(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)"
    return [text.rlike(words), F.contains(text, F.lit("AKIA")), text.rlike(r"[0-9a-f]{24}")]


def _with_matches(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with, under each name, the (start, end, said) of all leftmost non-overlapping matches of its pattern in ``__text``.

    They come from the lengths of matches and gaps: a running total within chunks, and one of the chunks' sums, so that
    a text's cost stays near its number of matches. Each step is a column that the next reads more than once, which
    keeps it from being worked out again for each element.
    """
    hits = {f"{name}_h": F.when(hint, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))) for name, (pattern, hint) in patterns.items()}
    gaps = {f"{name}_g": F.when(hint, F.split("__text", pattern, -1)) for name, (pattern, hint) in patterns.items()}
    pairs = {f"{name}_p": F.zip_with(f"{name}_h", f"{name}_g", lambda m, g: F.struct(F.coalesce(m, F.lit("")).alias("m"), g.alias("g"))) for name in patterns}
    span = "array<struct<start:int,end:int,said:string>>"

    def chunk(acc: Column, xs: Column) -> Column:
        at = F.aggregate(xs, acc["at"], lambda a, x: a + F.length(x["g"]) + F.length(x["m"]))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), xs.alias("xs")))).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("said")))).alias("out"))

    def found(name: str) -> Column:
        p = F.col(f"{name}_p")
        n = F.size(p) - 1  # the last is the gap behind the last match
        chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice(p, k * CHUNK + 1, F.least(F.lit(CHUNK), n - k * CHUNK)))
        none = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast("struct<at:int,out:array<struct<at:int,xs:array<struct<m:string,g:string>>>>>")
        begun = F.aggregate(chunks, none, chunk, lambda acc: acc["out"])
        spans = F.flatten(F.transform(begun, lambda c: F.aggregate(c["xs"], F.struct(c["at"].alias("at"), F.array().cast(span).alias("out")), step, lambda acc: acc["out"])))
        return F.when(n > 0, spans).otherwise(F.array().cast(span))

    seen = rows.withColumns({**hits, **gaps}).withColumns(pairs).withColumns({name: found(name) for name in patterns})
    return seen.drop(*hits, *gaps, *pairs)


def _base_span(rank: int, least: int, group: bool, pattern: str) -> Column:
    """(start, end, rank) of the matches of a known form that are long enough."""
    size = lambda m: F.length(F.regexp_extract(m["said"], pattern, 2) if group else m["said"])
    found = F.filter(f"__of{rank}", lambda m: size(m) >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank")))


def _tail(z: str, t: str) -> str:
    """SQL for P(a standard normal is over z), by a rational Chebyshev approximation; t is 1 / (1 + |z| / sqrt(8))."""
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda a, c: f"({a} * {t} + {c}D)", reversed(terms[:-1]), f"{terms[-1]}D")
    tail = f"0.5D * {t} * exp(-{z} * {z} / 2D + {poly})"
    return f"if({z} >= 0, {tail}, 1D - {tail})"


def _steps() -> list[tuple[str, dict[str, str]]]:
    """How a candidate c (start, end, said) is tested: fields kept from one step to the next, and new ones."""
    has = lambda p, n: f"if(c.said rlike '{p}', {n}D, 0D)"
    hexa = "c.said rlike '^([0-9a-f]+|[0-9A-F]+)$' and c.said rlike '[0-9]' and c.said rlike '[A-Fa-f]'"
    size = " + ".join([has("[0-9]", 10), has("[a-z]", 26), has("[A-Z]", 26), has("[-+/_]", 4), has("=", 1)])
    symbols = "array(" + ", ".join(f"'{x}'" for x in SYMBOLS) + ")"
    total = lambda over, what, by="x": f"aggregate(transform({over}, {by} -> {what}), 0D, (a, y) -> a + y)"
    # The alphabet of the inferred encoding: the classes of symbols that the candidate uses, in their usual order.
    classes = [f"if({test}, '{own}', '')" for test, own in (("c.said rlike '[0-9]'", SYMBOLS[:10]), (f"{hexa} and c.said rlike '[a-f]'", "abcdef"), (f"{hexa} and c.said rlike '[A-F]'", "ABCDEF"), (f"not ({hexa}) and c.said rlike '[A-Z]'", SYMBOLS[36:62]), (f"not ({hexa}) and c.said rlike '[a-z]'", SYMBOLS[10:36]), ("c.said rlike '[-+/_=]'", SYMBOLS[62:]))]
    high = "(x >= c.mean)"
    before = "get(c.v, i - 1)"
    zs = ("even", "runs", "serial", "ordinary")
    return [
        ("start end said", {"n": "cast(length(c.said) as double)", "hexa": hexa, "alphabet": f"concat({', '.join(classes)})"}),
        ("start end said n hexa alphabet", {"size": f"if(c.hexa, 16D, {size})", "letters": "c.said rlike '[A-Za-z]'"}),
        ("start end n size", {"same": f"if(c.hexa or not c.letters, {DIGIT_COINCIDENCE}D, {LETTER_COINCIDENCE}D)", "squares": total(symbols, "power(c.n - length(replace(c.said, x, '')), 2)"), "v": f"transform(filter(split(c.said, ''), x -> x <> ''), x -> cast(instr(c.alphabet, x) as double))"}),
        ("start end n size same squares v", {"mean": total("c.v", "x") + " / c.n"}),
        ("start end n size same squares", {"high": total("c.v", f"if({high}, 1D, 0D)"), "turns": total("c.v", f"if(i > 0 and {high} <> ({before} >= c.mean), 1D, 0D)", "(x, i)") + " + 1D", "spread": total("c.v", "power(x - c.mean, 2)"), "lag": total("c.v", f"if(i > 0, (x - c.mean) * ({before} - c.mean), 0D)", "(x, i)")}),
        ("start end n turns spread", {"df": "greatest(c.size - 1D, 1D)", "chi": "greatest(c.size / c.n * c.squares - c.n, 1e-9D)", "expected": "2D * c.high * (c.n - c.high) / c.n + 1D", "r": "c.lag / greatest(c.spread, 1e-9D)", "moved": "c.n * greatest(c.size * c.same - 1D, 0D)"}),
        ("start end n spread moved", {
            "even": "(power(c.chi / c.df, 1D / 3D) - (1D - 2D / (9D * c.df))) / sqrt(2D / (9D * c.df))",
            "varied": "(c.expected - 1D) * (c.expected - 2D) > 0D",
            "runs": "abs(c.turns - c.expected) / sqrt(greatest((c.expected - 1D) * (c.expected - 2D) / (c.n - 1D), 1e-9D))",
            "serial": "abs(c.r + 1D / c.n) * sqrt(c.n)",
            "ordinary": "(c.df + c.moved - c.chi) / sqrt(2D * (c.df + 2D * c.moved))",
        }),
        ("start end n spread moved varied " + " ".join(zs), {f"t_{z}": f"1D / (1D + abs(c.{z}) / sqrt(8D))" for z in zs}),
        ("start end n spread moved varied", {f"p_{z}": _tail(f"c.{z}", f"c.t_{z}") for z in zs}),
        ("start end n", {
            "half": "-(ln(greatest(c.p_even, 1e-30D)) + ln(if(c.varied, greatest(2D * c.p_runs, 1e-30D), 1e-9D)) + ln(if(c.spread > 0D, greatest(2D * c.p_serial, 1e-30D), 1e-9D)))",
            "ordinary": "if(c.moved > 0D, c.p_ordinary, 1D)",
        }),
        ("start end", {"n": "cast(c.n as int)", "chance": "exp(-c.half) * (1D + c.half + c.half * c.half / 2D)", "ordinary": "c.ordinary"}),
    ]


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs with ``__base`` spans and ``__tested`` candidates outside them: start, end, n, chance, ordinary."""
    rows = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    hints = _hints(F.col("__text"))
    forms = {f"__of{i}": (b[1], hints[i]) for i, b in enumerate(BASE)}
    rows = _with_matches(rows, {**forms, "__seen": (CANDIDATE, F.col("__text").rlike(CANDIDATE))})
    rows = rows.withColumn("__base", F.concat(*[_base_span(i, least, group, pattern) for i, (_, pattern, least, group) in enumerate(BASE)])).drop(*forms)
    # Known spans in groups of CHUNK by their starts: a candidate looks into a group only if it touches its range.
    first, n = F.array_sort("__base"), F.size("__sorted")
    span = "array<struct<start:int,end:int,rank:int>>"
    groups = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice("__sorted", k * CHUNK + 1, F.least(F.lit(CHUNK), n - k * CHUNK)))
    ranged = F.transform(groups, lambda xs: F.struct(xs.alias("xs"), F.get(xs, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(xs, lambda b: b["end"])).alias("hi")))
    rows = rows.withColumn("__sorted", first).withColumn("__groups", F.when(n > 0, ranged).otherwise(F.array().cast(f"array<struct<xs:{span},lo:int,hi:int>>")))
    touches = lambda c: F.exists("__groups", lambda g: (g["lo"] < c["end"]) & (c["start"] < g["hi"]) & F.exists(g["xs"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("__tested", F.when(F.size("__groups") > 0, F.filter("__seen", lambda c: ~touches(c))).otherwise(F.col("__seen")))
    for kept, new in _steps():
        fields = [f"c.{k} as {k}" for k in kept.split()] + [f"{v} as {k}" for k, v in new.items()]
        rows = rows.withColumn("__tested", F.expr(f"transform(__tested, c -> struct({', '.join(fields)}))"))
    return rows.drop("__text", "__seen", "__sorted", "__groups")


def _length_class(n: Column) -> Column:
    return reduce(lambda a, i: F.when(n < LENGTHS[i + 1], F.lit(i)).otherwise(a), range(len(LENGTHS) - 3, -1, -1), F.lit(len(LENGTHS) - 2))


def _bin(p: Column) -> Column:
    """Probabilities by quarters of a power of ten; the bin's upper edge is 10 ** (-bin / 4)."""
    return F.least(F.lit(BINS - 1), F.floor(F.lit(-4.0) * F.log10(F.greatest(p, F.lit(1e-30))))).cast("int")


def discovery_bins(candidates: DataFrame) -> list[int]:
    """For each class of length the least bin whose candidates are discoveries; BINS where there is none."""
    counts = candidates.select(F.explode("__tested").alias("c")).groupBy(_length_class(F.col("c.n")).alias("length"), _bin(F.col("c.ordinary")).alias("bin")).agg(F.count("*").alias("n"))
    found = {(r["length"], r["bin"]): r["n"] for r in counts.collect()}
    out = []
    for length in range(len(LENGTHS) - 1):
        own = [found.get((length, b), 0) for b in range(BINS)]
        total, taken, least = sum(own), 0, BINS
        for b in range(BINS - 1, -1, -1):
            taken += own[b]
            if taken and 10 ** (-b / 4) * total <= RATE * taken:
                least = b
        out.append(least)
    return out


def _with_spans(rows: DataFrame) -> DataFrame:
    least = F.array(*[F.lit(b) for b in discovery_bins(rows)])
    secret = lambda c: (c["chance"] >= KEEP_CHANCE) & (_bin(c["ordinary"]) >= F.get(least, _length_class(c["n"])))
    extra = F.transform(F.filter("__tested", secret), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(len(BASE)).alias("rank")))
    ordered = F.array_sort(F.transform(F.concat("__base", extra), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return rows.withColumn("__spans", ordered).drop("__base", "__tested")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of docs."""
    kinds = F.array(*[F.lit(b[0]) for b in BASE], F.lit(RANDOM))
    # Texts are searched once: the counts and the result read spans and candidates only.
    seen = with_candidates(docs.select("doc_id", "text")).drop("text")
    found = _with_spans(Scratch(docs.sparkSession, "secrets").keep(seen, "candidates"))
    base = F.filter("__spans", lambda s: s["rank"] < len(BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("__spans", lambda s: s["rank"] == i)).cast("long")
    counts = [count(i).alias(f"n_{b[0]}") for i, b in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("__spans")).alias("spans"))


def redact_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with each secret in text replaced by mask; touching and overlapping spans count as one.

    Texts are searched once; they are written with what was found, and the counts read that column only.
    """
    # The other columns travel in one, so that no name can clash.
    packed = docs.select(F.struct(*own_columns(docs)).alias("row"), "text")
    found = _with_spans(Scratch(docs.sparkSession, "redact").keep(with_candidates(packed), "candidates"))
    kind = "struct<at:int,parts:array<string>>"

    def step(acc: Column, s: Column) -> Column:
        parts = F.concat(acc["parts"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["parts"]).otherwise(parts).alias("parts"))

    cut = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.array().alias("parts")).cast(kind), step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    said = F.when(F.size("__spans") > 0, cut).otherwise(F.col("text"))
    return found.select("row", said.alias("said")).select(*[F.col("said").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
