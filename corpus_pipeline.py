"""From raw documents to packed training sequences; every stage is one of the operators in siltstone.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import durable, packing, pii, quality, rules, simhash


#: Of an Arrow batch: executors hold what all stages have left behind, so the stages move less at a time than the queries.
BATCH_BYTES = 1 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base limits or are outliers of their language and source (null texts fail)."""
    durable.bounded(spark, BATCH_BYTES)
    return rules.judge(rules.statistics(docs)).where("kept").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below 0.7.

    The labelled rows, at most `per_class` of each label, are taken from all documents: the former stage has taken
    away much of what is labelled bad.  Without any labels nothing is rejected.
    """
    durable.bounded(spark, BATCH_BYTES)
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.labels):
        return docs
    return quality.scores(docs, model, out="siltstone_score").where("siltstone_score >= 0.7").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: texts of which the five-word shingles are similar by 0.8 or more.

    The smallest id of a class stays.  Null, empty and blank texts are one class; rows that repeat an id are one document;
    rows without an id stay.
    """
    durable.bounded(spark, BATCH_BYTES)
    return simhash.survivors(docs, similarity=0.8, width=5).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind for each span of personal data, and counts the characters anew.

    Null texts stay null, with the count that they had; rows that repeat an id are redacted alike.  Texts and spans are
    written once, as models and redaction both need the spans.
    """
    durable.bounded(spark, BATCH_BYTES)
    own = docs.withColumn("siltstone_text", F.col("text"))
    spans = pii.candidates(pii.base_spans(own, "siltstone_text", "siltstone_base"), "siltstone_text", "siltstone_candidates").drop("siltstone_text")
    spans = durable.written(spans, "spans")
    model = pii.fit(spans, base="siltstone_base", proposed="siltstone_candidates")
    chosen = pii.select(spans, model, "siltstone_spans", "siltstone_base", "siltstone_candidates")
    return pii.redact(chosen, "text", "siltstone_spans").withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens, with as few documents in each as can be.

    Null and empty texts are the end id alone; rows that repeat an id are documents of their own.
    """
    durable.bounded(spark, BATCH_BYTES)
    # executors have held four stages' memory by now: half as many words are remembered as in the query by itself
    cut = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), words=150_000, step=512 << 10)
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), tighten=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: No SQL expresses the robust estimates, the classifier and the tokenizer; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
