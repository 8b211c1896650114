"""From documents to packed training sequences: five stages, each one corpus operator over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, lean_batches, small_side
from barloom.llm.jaccard import similar_texts
from barloom.llm.langid import predict_language, train_profiles
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.mixing import mix, words
from barloom.llm.packing import pack, token_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows sent to Python at once: the buffers of both sides stay beside those of five stages in one executor.
BATCH = 250

#: The language stage trains a model, so SQL cannot give run()'s rows; tests hold each stage against a plain version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter. Others pass unchanged, repeated rows too.

    Without a single labelled text there is one nameless profile, so that texts with letters stay.
    """
    lean_batches(spark, BATCH)
    profiles = train_profiles(docs, "text", "lang", size=300, per_lang=10_000, seed=11) or {"": np.zeros(1, np.int64)}
    # nothing of a text that has a letter can be predicted und while there is a profile
    return predict_language(docs.select(*COLUMNS), profiles, pred="__pred", score="__score").where("__pred <> 'und'").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten documents or more; n_chars follows the text. All documents stay, a null text as an empty one."""
    out = dedup_lines(docs, key=["doc_id", "lang", "source"], min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of similar texts, once if its row is repeated.

    Documents without words and rows without an id are in no group and stay. An id with several different texts names no
    one document: each of these texts stays, once. Of rows that share id and text the first by lang, source and n_chars
    stays. What goes is joined out, which is the short side.
    """
    docs = docs.select(*COLUMNS)
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("twice_id")).agg(F.count("*").alias("n"), (F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("several")).where("n > 1")
    twice = small_side(twice.select("twice_id", "several"))
    found = similar_texts(docs, words=5, percent=75).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = found.join(twice.where("several"), F.col("gone_id") == F.col("twice_id"), "left_anti")
    left = docs.join(small_side(gone), F.col("doc_id") == F.col("gone_id"), "left_anti")
    once = left.join(twice, F.col("doc_id") == F.col("twice_id"), "left_anti")
    again = left.join(twice, F.col("doc_id") == F.col("twice_id"), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("first"))
    return once.unionByName(again.select("doc_id", "text", "first.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it (twice at most); those it takes no copy of go, as do texts without words.

    Rows without an id or a source count as any other; a null source is a source of its own.
    """
    plan = mix(docs, weights=(3, 1, 2), total=1.5, cap=2.0).where("copies > 0")
    none = F.lit(-(1 << 63)).cast("long")
    key = lambda size, copy: [F.coalesce("doc_id", none).alias("k_id"), F.coalesce("source", F.lit("")).alias("k_source"), F.col("source").isNull().alias("k_none"), size.alias("k_size"), copy.alias("k_copy")]
    number = F.row_number().over(Window.partitionBy("k_id", "k_source", "k_none", "k_size").orderBy("text")).cast("long")
    rows = docs.select(*COLUMNS, *key(words("text"), F.lit(0))[:4]).withColumn("k_copy", number)
    taken = plan.select(*key(F.col("size"), F.col("copy")), "copies")
    joined = rows.join(taken, ["k_id", "k_source", "k_none", "k_size", "k_copy"])
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 1024; a null or empty text is its end token alone."""
    lean_batches(spark, BATCH)
    return pack(cut(token_pieces(docs)), order=["doc_id", "piece", "start", "ids_crc32"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("source_mix", mixture),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is checkpointed before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
