"""License scans with a positional index of rare words, in DataFrame functions only.

Templates are short licence passages; the base templates are phrases that must be found at every place. The
document frequency of each template word is counted over all documents. A template is posted in the index
under its ANCHORS rarest words (a base phrase under its single rarest), with each word's position. A file's
words that are in the index, its licence words of highest IDF, are looked up; a hit at position p of a
posting at position q says that the template would begin at p - q. Places on which enough anchors agree are
verified: the template's mandatory phrases must stand there word for word.

The index is made of literals in the plan; its size is the templates' size. Everything else stays in the
file's row: no shuffle but for the frequencies, and no join.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows repeat; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHORS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """words of a passage; phrases: (start in words, words) that must be there; base: the passage is one phrase."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool = False


def template(label: str, text: str, *phrases: str, base: bool = False) -> Template:
    words = tuple(text.split())
    found = []
    for phrase in phrases or (text,):
        own = tuple(phrase.split())
        found.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
    return Template(label, words, tuple(found), base)


BASE = (
    template("mit", "mit license", base=True),
    template("apache", "apache license", base=True),
    template("gpl", "general public license", base=True),
)
#: Passages of public licences with the phrases that tell them from each other.
PASSAGES = (
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can redistribute it and or modify it"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    template("mpl", "mozilla public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    template("cc", "creative commons attribution"),
    template("cc", "licensed under cc by"),
    template("apache", "licensed under the apache license version", "apache license version"),
    template("gpl", "licensed under the gnu general public license version", "gnu general public license version"),
    template("mit", "released under the mit license", "under the mit license"),
    template("bsd", "bsd license"),
    template("proprietary", "all rights reserved"),
)


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id and ``__words``, the lower-cased words of each whole text."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.filter(F.split(text, SEPARATORS), lambda w: w != "").alias("__words"))


def document_frequencies(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Number of documents with each template word; at most a row for each word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    own = F.array_distinct(F.filter("__words", lambda w: w.isin(vocabulary)))
    counts = words.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in counts.collect()}


def _anchors(t: Template, often: dict[str, int]) -> list[int]:
    """Positions of a template's rarest words, each word once."""
    rarest = sorted({w: i for i, w in reversed([*enumerate(t.words)])}.items(), key=lambda x: (often[x[0]], x[1]))
    return [i for _, i in rarest[: 1 if t.base or len(t.phrases[0][1]) == len(t.words) else ANCHORS]]


def _listed(words: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _places(templates: tuple[Template, ...], need: list[int]) -> tuple[str, str]:
    """SQL for the candidate places in ``__hits``, ordered by (t, at), and for the verified of ``__places`` with ``__words``.

    A place is a candidate where as many hits in a row agree as its template needs: one look at the last of them tells.
    """
    least = "array(" + ", ".join(map(str, need)) + ")"
    hit = lambda i: f"get(__hits, {i})"
    run = f"filter(sequence(0, size(__hits) - 1), i -> {hit('i')}.at >= 0 and not ({hit('i - 1')} <=> {hit('i')}) and {hit('i + get(' + least + ', ' + hit('i') + '.t) - 1')} <=> {hit('i')})"
    places = f"if(size(__hits) > 0, transform({run}, i -> {hit('i')}), cast(array() as array<struct<t:int,at:int>>))"
    tests = [" and ".join(f"slice(__words, a.at + {start + 1}, {len(own)}) = {_listed(own)}" for start, own in t.phrases) for t in templates]
    verified = "filter(__places, a -> case a.t " + " ".join(f"when {i} then {test}" for i, test in enumerate(tests)) + " end)"
    words = "case a.t " + " ".join(f"when {i} then {_listed(t.words)}" for i, t in enumerate(templates)) + " end"
    size = "get(array(" + ", ".join(str(len(t.words)) for t in templates) + "), a.t)"
    agreed = f"aggregate(zip_with(slice(__words, a.at + 1, {size}), {words}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x) / cast({size} as double)"
    return places, f"transform({verified}, a -> struct(a.t as t, cast(a.at as bigint) as at, {agreed} as agreed))"


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = (*BASE, *PASSAGES)) -> DataFrame:
    """doc_id, ``__words`` and ``__found``: (template, at, agreed) of every verified place.

    agreed is the share of the template's words that stand at their places.
    """
    words = with_words(docs)
    often = document_frequencies(words, templates)
    posted: dict[str, list[tuple[int, int]]] = {}
    need = []
    for number, t in enumerate(templates):
        places = _anchors(t, often)
        need.append((len(places) + 1) // 2)
        for q in places:
            posted.setdefault(t.words[q], []).append((number, q))
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    rare = F.filter(F.sequence(F.lit(0), n - 1), lambda i: word(i).isin(sorted(posted)))
    rows = words.withColumn("__rare", F.when(n > 0, rare).otherwise(F.array().cast("array<int>")))
    index = F.create_map(*[x for w, own in sorted(posted.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in own]))])
    hits = F.flatten(F.transform("__rare", lambda i: F.transform(index[word(i)], lambda p: F.struct(p["t"].alias("t"), (i - p["q"]).alias("at")))))
    none = F.array().cast("array<struct<t:int,at:int>>")
    rows = rows.withColumn("__hits", F.when(F.size("__rare") > 0, F.sort_array(hits)).otherwise(none))
    places, found = map(F.expr, _places(templates, need))
    return rows.withColumn("__places", places).withColumn("__found", found).select("doc_id", "__words", "__found")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs."""
    templates = (*BASE, *PASSAGES)
    found = find_licenses(docs, templates)
    names = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("__found", lambda f: f["t"] < len(BASE))
    rows = found.select("doc_id", F.size("__words").cast("long").alias("n_words"), "__found", base.alias("__base"))
    starts = F.transform("__base", lambda f: f["at"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: F.get(names, f["t"])))), ",")
    score = F.coalesce(F.array_max(F.transform("__found", lambda f: f["agreed"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("__base").alias("base_labels"), labels("__found").alias("labels"), score.alias("score"))
