"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes each result as Parquet and reads it again as the
next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import bpe, language_id, line_dedup, mixing, near_duplicates
from linkweave.llm._scratch import drop, store, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the model tells, with ``lang`` set to it.

    Those without a letter go, those that score less than documents of known language
    that weren't learned from, and ambiguous ones unless the model agrees with their
    own lang.  Neither ``und`` nor texts without a letter are learned.  Without any
    document to learn from those with a letter stay, with lang as it came.
    """
    letters = F.col("text").rlike(r"\p{L}")
    labelled, fold = docs.filter((F.col("lang") != "und") & letters), language_id.remainder("doc_id", 4)
    model = language_id.fit(labelled.filter(fold != 2), "doc_id", "text", "lang")
    if model is None:
        return docs.filter(letters).select(*COLUMNS)
    told = F.col("score") >= language_id.least_score(labelled.filter(fold == 2), model)
    sure = ~F.col("ambiguous") | F.col("lang").eqNullSafe(F.col("lang_pred"))
    rows = language_id.predict(docs, model).filter((F.col("lang_pred") != "und") & told & sure)
    return rows.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of repeated line runs; documents of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs).filter("lines_removed < n_lines")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest id.

    Rows are told apart by id and text hash, so equal ids with other texts are other
    documents, and of rows equal in both one stays.
    """
    key = F.struct("doc_id", "text_hash")
    groups = store(near_duplicates.similar_documents(docs).select("doc_id", "text_hash", "component_class"))
    first = groups.filter("component_class is not null").groupBy("component_class").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = groups.join(first, "component_class").filter(~key.eqNullSafe(F.col("first"))).select("doc_id", "text_hash").distinct()
    rows = docs.withColumn("text_hash", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash"))
    return rows.join(gone.alias("g"), same, "left_anti").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by temperature, to a budget of all words that are left."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and the SHA-256 of the bytes they decode to."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest="decoded_sha256")
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("temperature mixing", mixture),
    ("byte-level BPE", tokens),
]

#: Language ID, mixing and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = docs
        with temporary() as keep:
            docs = keep(store(stage(spark, before, sf_dir)))
        drop(before)
    return docs
