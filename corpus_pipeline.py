"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm.common import read_table, settled
from marketloom.llm.mixing import mix_documents
from marketloom.llm.packing import pack_documents
from marketloom.llm.simhash import keep_unlike
from marketloom.llm.toxicity import drop_toxic
from marketloom.shipping import ship

#: Near copies have LEAST of their five-word shingles in common. They differ in up to a dozen bits of a fingerprint of word pairs, about
#: two fifths of them in at most NEAR_BITS: independent fingerprints find most as candidates, which are then compared exactly.
LEAST, WIDTH, NEAR_BITS, STREAMS = 0.8, 2, 4, 8
#: Shares of the mix's tokens; no toxic ones are wanted, though soft posteriors leave a few.
MIX = {"high": 0.95, "low": 0.05, "toxic_high": 0.0, "toxic_low": 0.0}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; SimHash links, looser than the operator's default, give the candidates, which are compared exactly."""
    return keep_unlike(docs, budget=NEAR_BITS, least=LEAST, width=WIDTH, streams=STREAMS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the expected tokens of each domain meet MIX as nearly as can be; none twice."""
    return mix_documents(docs, read_table(spark, sf_dir, "labels"), MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: A learned score and an iterative fit have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next, whose scratch tables are deleted."""
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
