"""The training-text pipeline: each stage works on all that its predecessor kept.

toxicity rejects documents; lines deletes later copies of repeated runs of lines and keeps every row; near_dups keeps
one document of each group; leaks cuts benchmark passages out and keeps every row; pieces cuts texts into
sampled pieces, whose decoding gives the text back. All but the last return the columns of documents.

Defined results: null and empty texts go through all stages (toxicity gives them the score of a text without features; they have
no lines to repeat, no shingles, no test words and no pieces); of rows that are equal in doc_id and text one stays, by near_dups,
if they have words, and all if they have none; rows with a null doc_id stay; of documents that tie, the smallest doc_id is the one that is
kept. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontam, linededup, minhash, neighbours, pieces
from foliospark.llm.common import cut, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neighbours.reject(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs).select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).select("doc_id", "lang", "source", "n_chars", "pieces", "n_pieces", "lossless")


STAGES = [("toxicity", toxicity), ("lines", lines), ("near_dups", near_dups), ("leaks", leaks), ("pieces", encoded)]

#: SQL can't express the stages; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from what the one before has written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
