"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanloom.llm.common import cut, table
from cleanloom.llm.mixing import mix
from cleanloom.llm.neardup import near_dedup
from cleanloom.llm.pieces import sampled
from cleanloom.llm.pii import redact
from cleanloom.llm.quality import host_rules
from cleanloom.llm.workload import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host fails, go."""
    return host_rules(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes near its target; documents are repeated or left out for it."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return sampled(docs, tokenizer_file("piece_bpe_32k.model"), keep=[docs["doc_id"]]).select(
        "row.doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids", "round_trip")


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", minhash_near_dedup), ("pii", pii), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Hashes, signatures and sampled segmentations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
