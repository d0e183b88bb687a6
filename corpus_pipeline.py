"""Corpus pipeline: language ID, MinHash near-dedup, benchmark decontamination, secret scan, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in the columns of ``documents``; the last one
returns doc_id with the ids of each kept text and whether they decode to it. Stages are written as Parquet in the
cluster's shared folder and reread. Language ID drops texts that have no language, an unsure one, or one that isn't learned; near-dedup keeps the
document of the smallest id of each group (alike are texts whose sets of five successive words have a similarity of 0.8); decontamination drops contaminated documents; the secret scan keeps every
document, with its secrets replaced by a mark, and sets n_chars anew.

Null and empty texts and texts without a letter go in the first stage; the later ones, called by themselves, keep them: they are like no other
document, have no window of the benchmark and no secret, and encode to no ids. Very long texts are handled whole in every
stage. Repeated rows of one id stay or go together, copies under different ids leave the smallest id, and ties in a language's score go to the
language first in order. An empty table gives no rows in any stage. Further columns, of any name, pass the first four
stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import contamination, langid, minhash, secrets, triebpe
from saltmarsh.llm._io import cut, prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return contamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return triebpe.round_trip(docs.select("doc_id", "text"), triebpe.vocabulary())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", encoding),
]

#: No SQL can express language ID by context trees or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
