"""The queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, decontaminate, exact, licenses, linededup, mixing, pii, quality, simhash, spm, tokenfiles, warc
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401  (part of this module's interface)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: per row its size, its source's size and target, and the words taken. Null texts have no words
    and are taken 0 words; a null source is a source; rows with one id fare alike; no documents, no rows."""
    planned = mixing.with_copies(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base_failed and kept for every document. Null texts have no words and fail; null languages and sources are
    groups of their own; no documents, no rows."""
    judged = quality.score(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 words or more that repeat an earlier one: a row for each, with offsets in the whole text. Null and
    empty texts have none; rows equal in id and text are one document; null ids rank last; no documents, no rows."""
    return linededup.spans(table(spark, sf_dir, "documents")).drop("doc_hash")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text and whether decoding gives it back. Null and empty texts have no ids; repeated rows are
    encoded each; no documents, no rows."""
    rows = spm.encoded(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_ok")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the token files: start, n_tokens with the end id, and the CRC-32 of the ids. Null texts are empty;
    null ids come first; rows with one id follow each other by text; no documents, no rows."""
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives: bytes and SHA-1 of the payload, record type and what it refers to. A null html is an empty
    payload; rows equal in id and payload have the same type; no pages, no rows."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id of its component. Null and empty texts have fingerprint 0, linked
    like any other; null ids are allowed; no documents, no rows."""
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every whole text. Null and empty texts have none; equal texts have the same spans;
    null ids are allowed; no documents, no rows."""
    rows = pii.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    base = F.sha2(pii.joined(F.col("spans")).cast("binary"), 256)
    return rows.select("doc_id", *counts, base.alias("base_sha256"), pii.joined(F.concat("spans", "term_spans")).alias("spans"), F.size(F.concat("spans", "term_spans")).cast("long").alias("n_spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one that stays of its group of equal texts, added to a digest index in four batches in id order.
    Null texts are empty texts; null ids come last; no documents, no rows."""
    return exact.dedup(table(spark, sf_dir, "documents"), batches=4)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses found in every whole text, a row for each place. Null and empty texts have none; repeated rows repeat their
    matches; no documents, no rows."""
    return licenses.matches(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document tokens, groups and links of two tokenizers, and the links' corpus counts. Null and empty texts have no
    tokens; repeated rows each count; null ids are allowed; no documents, no rows."""
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    rows = alignment.aligned(table(spark, sf_dir, "documents"), a, b, ["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = alignment.written(rows.withColumn("groups_sha256", digest).drop("groups"))
    out = alignment.scored(rows, a, b, ["doc_id", *alignment.COUNTS, "groups_sha256"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words that stand in a window of a benchmark item, and those items. Null and empty texts have no words;
    items without an id are not named; repeated rows are judged each; no documents, no rows."""
    rows = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontaminate.n_hit()
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation faults, cost, edits and digest of its repair after damage. Nulls count as one space; a null conv_id is a
    conversation; no conversations, no rows."""
    return conversations.summaries(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_quality_rules, op3_line_dedup, op4_sentencepiece, op5_token_files, op6_warc, op7_simhash, op8_pii, op9_exact_dedup, op10_license_scan, op11_tokenizer_alignment, op12_decontamination, op13_conversation_repair)
}
