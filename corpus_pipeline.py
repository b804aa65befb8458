"""A corpus pipeline over the table documents, in stages that each call one operator.

A stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns a frame that is
written as Parquet and read again as the next stage's docs. All but the last return docs' own columns.

Defined results for odd input, in every stage: rows with a null text are rejected by the first stage, which
finds no language in them; rows with a null doc_id are kept by all stages; repeated rows share their fate
where texts are judged, and one of them stays where copies are removed; an empty table stays empty; columns
beside doc_id and text pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm import bpe, decontaminate, langid, minhash, secret_scan
from spanframe.llm._text import fresh, own_columns
from spanframe.llm.queries import TOKENIZER
from spanframe.scratch import Scratch

ORACLE_SQL = None  # SQL has no counterpart of the fitted language filters and of the tokenization automaton


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a known language is found, whatever its share; the filters learn from all labelled rows of docs."""
    known = docs.select("text", "lang").where(F.col("lang").isNotNull())
    return langid.keep_known(docs, langid.fit_languages(known))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8) the least doc_id.

    Rows that share a doc_id are copies of one document if their texts are equal. Other texts under one doc_id
    are documents of their own.
    """
    columns, known = own_columns(docs), docs.where("doc_id is not null")
    said = F.coalesce(F.md5("text"), F.lit(""))
    many = known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(said).alias("a"), F.max(said).alias("b")).where("rows > 1")
    many = Scratch(spark, "near-dedup").keep(many, "repeated")
    if many.where("a <> b").isEmpty():
        gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
        kept = docs.join(gone, "doc_id", "left_anti").select(*columns)
        repeated = many.select("doc_id")
        return kept.join(repeated, "doc_id", "left_anti").select(*columns).union(_one_of_each(kept.join(repeated, "doc_id", "left_semi").select(*columns), "doc_id"))
    # Each text gets an id of its own, and a group is left with its least doc_id.
    (node,) = fresh(docs, "node")
    texts = _one_of_each(known, "doc_id", "text").withColumn(node, F.monotonically_increasing_id())
    texts = Scratch(spark, "near-dedup").keep(texts, "texts")
    groups = minhash.near_duplicates(texts.select(F.col(node).alias("doc_id"), "text")).select(F.col("doc_id").alias(node), "component_id")
    named = groups.join(texts.select(node, F.struct("doc_id", said.alias("said"), F.col(node).alias("node")).alias("name")), node)
    least = named.groupBy("component_id").agg(F.min("name").alias("name")).select(F.col("name.node").alias(node))
    return texts.join(least, node, "left_semi").select(*columns).union(docs.where("doc_id is null"))


def _one_of_each(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys: the one whose other columns hash least, so the choice is the same every time."""
    hashed = [c for c, field in zip(own_columns(docs), docs.schema.fields, strict=True) if not isinstance(field.dataType, (T.MapType, T.VariantType))]
    best = docs.groupBy(*keys).agg(F.min_by(F.struct(*own_columns(docs)), F.xxhash64(*hashed)).alias("row"))
    return best.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and masks the secrets in their texts; n_chars follows the text."""
    masked = secret_scan.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the text decoded from them, and n_tokens of each document."""
    return bpe.encode_decode(docs, TOKENIZER).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
