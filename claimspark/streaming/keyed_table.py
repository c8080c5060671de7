"""A keyed table that a stream keeps up to date, safe to restart (IO15, US12).

The table lies in buckets by a hash of its keys. A micro-batch writes the buckets it touches under its own number and then
a manifest, one file, which names for every bucket the batch that wrote it last. Readers see the newest manifest, so they
see whole batches only; a batch that is run again finds its manifest written and does nothing, or starts afresh."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut
from ..operators.windows import top1

#: Buckets of a table; each is rewritten whole when a batch touches it.
BUCKETS = 16
#: Fixed value: requests that the usage log keeps.
MOST_HISTORY = 10_000

_MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("buckets", T.IntegerType()), T.StructField("lifetime", T.LongType())])


class State(NamedTuple):
    version: int
    #: The batch that wrote each bucket last.
    written: dict[int, int]
    buckets: int
    #: Rows ever added with a key that the table did not hold at the time.
    lifetime: int


def state(spark: SparkSession, path: str) -> State | None:
    """What the newest manifest says; None for a table without any batch."""
    try:
        found = spark.read.schema(T.StructType([*_MANIFEST.fields, T.StructField("version", T.LongType())])).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = found.agg(F.max("version")).first()[0]
    rows = found.filter(F.col("version") == newest).collect() if newest is not None else []
    return State(newest, {r.bucket: r.batch for r in rows if r.bucket is not None}, rows[0].buckets, rows[0].lifetime) if rows else None


def _read(spark: SparkSession, path: str, written: dict[int, int]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/data/{batch}/bucket={bucket}" for bucket, batch in sorted(written.items())])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows after its last whole batch. A table without any batch is an error."""
    now = state(spark, path)
    if now is None or not now.written:
        raise ValueError(f"no batch has been merged into {path}")
    return _read(spark, path, now.written)


def merge_batch(batch: DataFrame, number: int, path: str, keys: Sequence[str], order: Sequence[str], keep: int | None = None, buckets: int = BUCKETS) -> None:
    """Merges micro-batch ``number``: of rows with equal keys (nulls are equal) that with the greatest ``order`` columns
    stays, the newer batch's if those are equal too. With ``keep`` only so many rows stay, those with the greatest order,
    then the least keys; such a table, whose size that bounds, is one bucket."""
    spark = batch.sparkSession
    buckets = 1 if keep is not None else buckets
    now = state(spark, path)
    if now is not None and now.version >= number:
        return
    if now is not None and now.buckets != buckets:
        raise ValueError(f"{path} has {now.buckets} buckets, not {buckets}")
    first = [F.col(c).desc_nulls_last() for c in order]
    new = cut(top1(batch, keys, first).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    touched = {r.bucket for r in new.select("bucket").distinct().collect()}
    if not touched:
        return
    written, lifetime = (dict(now.written), now.lifetime) if now is not None else ({}, 0)
    before = {b: w for b, w in written.items() if b in touched}
    merged, added = new, new.count()
    if before:
        old = _read(spark, path, before)
        equal = reduce(lambda x, y: x & y, (new[k].eqNullSafe(old[k]) for k in keys))
        added = new.join(old, equal, "left_anti").count()
        both = old.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        merged = top1(both, keys, [*first, F.col("__new").desc()]).drop("__new")
    if keep is not None:
        merged = merged.orderBy(*first, *keys).limit(keep)
    merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
    rows = [(b, w, buckets, lifetime + added) for b, w in sorted((written | dict.fromkeys(touched, number)).items())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")


def merge_stream(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], decide: Callable[[DataFrame], DataFrame] | None = None, keep: int | None = None, buckets: int = BUCKETS
):
    """Keeps the table at ``path`` up to date with a stream: every micro-batch goes through ``decide`` (joins with static
    dimensions, decisions), where it is given, and is merged. Returns the query."""

    def each(batch: DataFrame, number: int) -> None:
        merge_batch(decide(batch) if decide else batch, number, path, keys, order, keep, buckets)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tidy(spark: SparkSession, path: str, versions: int = 2) -> int:
    """Deletes what no manifest of the last ``versions`` names; readers of older ones must have ended. Returns how many
    folders went."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    kept = sorted((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")) if s.getPath().getName().startswith("version=")), reverse=True)
    named = spark.read.parquet(*[f"{path}/manifest/version={v}" for v in kept[:versions]]).select("batch").distinct()
    used = {str(r.batch) for r in named.collect()}
    # A batch that is being written has no manifest yet: only folders of batches before the newest manifest go.
    data = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/data"))]
    gone = [p for p in data if p.getName().isdigit() and int(p.getName()) < kept[0] and p.getName() not in used]
    gone += [jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/version={v}") for v in kept[versions:]]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
