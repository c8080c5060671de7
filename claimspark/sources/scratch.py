"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a session in one process has a temporary folder of its own; on a cluster,
    whose machines would not see each other's files, it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table is broadcast only after counting at most so many rows in it.
BROADCAST_ROWS = 20_000


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it holds at most ``rows`` rows, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where it would be read in fewer tasks than there are cores: work on texts takes longer than dealing
    out so small an input. Larger inputs stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Short rows that one task takes at most where deal() deals them out.
TASK_ROWS = 500_000


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt anew over all cores, or by keys, in tasks of some ``TASK_ROWS`` rows: for tables of short rows, many of
    which fit in one file or row group, so that few tasks read them, before work that takes longer than dealing them out;
    by keys so that what is grouped or joined by them afterwards takes bounded memory a task, whatever the number of
    shuffle partitions is. The rows are counted, for a plain table from the files' footers."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / TASK_ROWS)), *keys)
