"""The pipeline against a plain version of its stages on a small corpus."""

import random

import brute


import corpus_pipeline
from spanframe.llm import bpe
from spanframe.llm.queries import TOKENIZER

EN = "the weather in the north was cold and the river had frozen over so they walked across it to reach the village before dark".split()
FR = "le temps dans le nord était froid et la rivière avait gelé alors ils ont marché dessus pour arriver au village avant la nuit".split()


def corpus():
    r = random.Random(8)
    said = lambda words, k: " ".join(r.choice(words) for _ in range(k))
    item = said(EN, 14)
    docs = []
    for i in range(40):
        words = EN if i % 2 else FR
        text = said(words, 60 + i)
        if i % 8 == 3:
            text += " " + item + " " + said(words, 9)
        if i % 8 == 4:
            text = docs[i - 2][1] if i % 16 == 4 else docs[i - 2][1] + " fin"
        if i % 8 == 5:
            text += f" password: hunter{i}xy and more"
        docs.append((i, text, "en" if i % 2 else "fr"))
    docs += [(50, None, "en"), (51, "", "fr"), (52, "123 456 !!", "en"), (53, "ああ いい うう ええ おお", None)]
    return docs, item


def frames(spark, tmp_path, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    spark.createDataFrame([(i, t, g, None, len(t or ""), "clash") for i, t, g in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_the_whole_pipeline(spark, tmp_path):
    docs, item = corpus()
    where = frames(spark, tmp_path, docs, [(1, item), (2, None)])
    kept = {i: t for i, t, g in docs if i < 50}  # the others are in no known language
    near = brute.near_duplicates(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if near[i][1] == i}
    kept = {i: t for i, t in kept.items() if not brute.contamination(t, [(1, item)])[4]}
    model, want = bpe.WordBpe(bpe.load(TOKENIZER)), {}
    for i, t in kept.items():
        for a, _, b in reversed(brute.base_secrets(t)):
            t = t[:a] + "[SECRET]" + t[b:]
        want[i] = model.encode(t)
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, where).collect()}
    assert got == want
    assert 0 < len(want) < 40


def test_stages_keep_the_columns(spark, tmp_path):
    odd = [(None, "the cold river " * 9, "en"), (None, None, None), (5, "the cold river froze " * 9, "en"), (5, "the cold river froze " * 9, "en"), (6, "village in the north", "en")]
    where = frames(spark, tmp_path, odd, [(None, "x"), (1, "")])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, where).count() == 3


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, frames(spark, tmp_path, [], [])).count() == 0




def test_short_clean_texts_stay(spark, tmp_path):
    docs, _ = corpus()
    docs = [d for d in docs if d[0] < 50]
    foreign = "".join(chr(0x3042 + i % 80) + " " * (i % 7 == 0) for i in range(5000))
    docs += [(60, "All rights reserved.", None), (61, "A.\nAll rights reserved.", None), (62, "the", None), (63, foreign, None)]
    where = frames(spark, tmp_path, docs, [])
    kept = corpus_pipeline.language(spark, spark.read.parquet(f"{where}/documents.parquet"), where)
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - {63}


def test_other_texts_under_one_id_stay(spark, tmp_path):
    r = random.Random(1)
    a, b, c = (" ".join(r.choice(EN) for _ in range(80)) for _ in range(3))
    docs = [(3, a, "en"), (5, b, "en"), (5, a + " end", "en"), (5, c, "en"), (5, c, "en"), (9, c + " end", "en"), (None, a, "en"), (7, None, "en"), (7, "", "en")]
    where = frames(spark, tmp_path, docs, [])
    table = spark.read.parquet(f"{where}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, table, where)
    assert out.columns == table.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (5, c), (None, a), (7, None), (7, "")], key=str)


def test_the_last_stage_decodes(spark, tmp_path):
    where = frames(spark, tmp_path, [(1, "The Cold  river, froze.", "en"), (2, None, "en")], [])
    model = bpe.WordBpe(bpe.load(TOKENIZER))
    out = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{where}/documents.parquet"), where)
    got = {r["doc_id"]: (list(r["ids"]), r["n_tokens"], r["decoded"]) for r in out.collect()}
    ids = model.encode("The Cold  river, froze.")
    assert got == {1: (ids, len(ids), model.decode(ids)), 2: ([], 0, "")} and "cold</w> river" in got[1][2]
