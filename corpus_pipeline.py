"""A training-text pipeline in five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. The stages treat odd rows as their operators say: null texts
count as empty (and fall to the quality rules, having fewer than 50 words), null ids, languages and sources are
allowed, repeated rows are copies of each other, an empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import exact, mixing, nearcopies, quality, simhash, spm
from claimspark.llm.common import cut, table
from claimspark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's adaptive thresholds reject go."""
    return quality.keep_good(docs.select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays."""
    return exact.keep_first(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash fingerprints within 2 bits, or five-word Jaccard of 0.8 or more), the one with
    the smallest doc_id stays."""
    return nearcopies.keep_representatives(docs.select(*COLUMNS), radius=simhash.RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says; repeated documents are repeated rows."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_ids, ids and decoded_ok for every row of the mix."""
    rows = spm.encoded(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "source"])
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_ok")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("encode", encode),
]

#: SentencePiece ids can't be had from SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
