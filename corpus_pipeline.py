"""A training corpus from raw documents, in five stages; each one's Parquet is the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. The first four return the
columns of documents: toxicity drops documents that it rejects, deduplication keeps one document of each group of near
copies, decontamination drops documents that quote the benchmark, secrets masks credentials and keeps every document.
The last packs what is left into sequences and returns a row for each piece.

Defined results: a null text counts as empty; empty texts pass the first four stages (a null one stays null) and are
packed as their end id alone. Of rows with one doc_id and one text the second stage keeps one; rows with one doc_id and
different texts are documents of their own; rows without doc_id are all kept. Empty tables give empty tables, and texts may
be as long as they like. Columns other than doc_id, text and n_chars, which the fourth stage counts anew, are passed
through unread up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import common, decontam, minhash, packing, secretscan, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of these documents, scores below one half."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that share four fifths of their shingles of five words."""
    return minhash.deduplicate(docs, shingle=5, threshold=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Near-duplicate components, automata and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
