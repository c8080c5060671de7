"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, anti-joined with the
index bucket by bucket (a sort-merge join that does not shuffle the index), and its new digests are appended. Each append
adds a file to every bucket; compact() writes the index anew with one sorted file for each.

Texts are equal when they are identical after each run of spaces, tabs and line breaks is replaced by one space. A null
text is the empty text; of equal texts the row with the smallest doc_id stays, a null doc_id coming last; rows that
repeat both text and doc_id all point to that doc_id, and one of them counts as kept by doc_id alone. An empty batch
appends nothing. Digests are SHA-256, 32 bytes in the index. The index keeps the row that came first: batches in ascending
doc_id order give the smallest doc_id of all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, maybe_broadcast, scratch_path, text_of

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT"
#: So many row numbers (8 bytes each) are broadcast at most; more are met in a shuffled join.
BROADCAST_NUMBERS = 500_000


def digest_of(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, runs of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACES, " ").cast("binary"), 256))


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """Registers the index kept at path (made if it isn't there) and returns its table name. The number of buckets
    belongs to the files, so later sessions must open the index with the number it was made with."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"digest_index_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path}'")
    return name


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"))


def _buckets(index: str, spark: SparkSession) -> int:
    return int(spark.sql(f"DESCRIBE FORMATTED {index}").filter("col_name = 'Num Buckets'").first()["data_type"])


def _append(index: str, rows: DataFrame) -> None:
    rows.select("digest", "keep_id").repartition(_buckets(index, rows.sparkSession), "digest").write.insertInto(index)
    rows.sparkSession.catalog.refreshTable(index)


def compact(index: str, path: str) -> str:
    """The index as a new table at path, with one sorted file for each bucket."""
    spark = SparkSession.getActiveSession()
    new = open_index(spark, path, _buckets(index, spark))
    _append(new, spark.table(index))
    return new


def add_batch(index: str, hashed: DataFrame) -> DataFrame:
    """Appends the digests of hashed(doc_id, digest) that the index lacks; returns the batch's groups as a written
    table (digest, keep_id, copies, new), one row per digest. keep_id is the row that the index keeps for the digest: of
    the batch for a new one, else of an earlier batch. copies counts the batch's rows."""
    spark = hashed.sparkSession
    groups = cut(hashed.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")), "exact-groups")
    held = spark.table(index)
    known = cut(groups.alias("g").join(held.alias("i").hint("merge"), "digest").select("digest", F.col("i.keep_id"), "copies", F.lit(False).alias("new")), "exact-known")
    new = cut(groups.join(held.hint("merge"), "digest", "left_anti").withColumn("new", F.lit(True)), "exact-new")
    _append(index, new)
    return new.unionByName(known)


def add_in_batches(index: str, hashed: DataFrame, batches: int) -> DataFrame:
    """Adds hashed(doc_id, digest), a written table, in so many batches of about equal size in doc_id order, null ids last;
    returns (digest, keep_id, copies) of all."""
    bounds = sorted(set(hashed.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    edges, out = [None, *bounds, None], None
    for low, high in zip(edges, edges[1:], strict=False):
        part = hashed
        if low is not None:
            part = part.filter(F.col("doc_id").isNull() | (F.col("doc_id") > low)) if high is None else part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        groups = add_batch(index, part)
        out = groups if out is None else out.unionByName(groups)
    return cut(out.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies")), "exact-all")


def resolve(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of hashed with keep_id, group_size and kept. Both sides come from tables, so that a digest with many
    copies is split by the skew join."""
    same = hashed.join(groups.select("digest", "keep_id", F.col("copies").alias("group_size")), "digest")
    return same.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None, batches: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size (rows of docs), kept, text_sha256. Without index_path a fresh
    index is made in the shared folder."""
    spark = docs.sparkSession
    index = open_index(spark, index_path or scratch_path(spark, "exact-index"), buckets)
    try:
        hashed = cut(digests(docs), "exact-digests")
        out = resolve(hashed, add_in_batches(index, hashed, batches))
        return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    finally:
        spark.sql(f"DROP TABLE {index}")  # the files stay: the table lies outside the warehouse


def keep_first(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """docs without the rows whose text the index knows, and without those that repeat an earlier row's text: one row of
    each group of equal texts, all columns. Where rows have both text and doc_id in common, the one numbered first stays.

    Rows are numbered when they are written with their digests. Digests and numbers alone are grouped and joined; the
    rows that go are few beside those that stay, so they are taken out and the texts need not be shuffled as long as the
    numbers to take out can be broadcast."""
    spark = docs.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = cut(docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"), F.monotonically_increasing_id().alias("number")), "exact-rows")
    index = open_index(spark, index_path or scratch_path(spark, "exact-index"), buckets)
    try:
        new = add_batch(index, rows.select("doc_id", "digest")).filter("new").select("digest")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "number"))["number"]
        firsts = rows.select("doc_id", "digest", "number").groupBy("digest").agg(first.alias("number")).join(new, "digest", "left_semi")
        go = cut(rows.select("number").join(cut(firsts.select("number"), "exact-stay"), "number", "left_anti"), "exact-go")
        return rows.join(maybe_broadcast(go, BROADCAST_NUMBERS), "number", "left_anti").select("row.*")
    finally:
        spark.sql(f"DROP TABLE {index}")
