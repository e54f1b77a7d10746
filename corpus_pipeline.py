"""Corpus pipeline: quality rules, near-duplicates, secrets, source mixing, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import common, mixing, piece_fst, quality_rules, secrets_scan, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.quality_cascade(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: those whose fingerprints are within three bits, or whose five-word sets are 0.8 alike; the
    one of the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets_scan.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources are repeated towards equal weights, 1.25 times at most."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the outcome of decoding them again."""
    return piece_fst.piece_report(docs, with_pieces=True)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("secret scans", secrets), ("source mixing", mix), ("sentencepiece", pieces)]
#: Fingerprint classes, compressed sizes and shortest paths have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole of ``documents``; each reads its predecessor's written table, which goes once it is read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = common.saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if i:
            common.dropped(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir) if STAGES else docs
