"""A training corpus in four stages: quality rules, near-copies, source mix, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemicycle.llm import mixing, quality, sentencepiece_scan, simhash
from hemicycle.llm._shared import materialise
from hemicycle.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids and the text decoded from them, as lengths and checksums."""
    return sentencepiece_scan.piece_digest(sentencepiece_scan.encode(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing sources", source_mix),
    ("sentencepiece", pieces),
]

#: Hashed n-grams, SimHash and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each one's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
