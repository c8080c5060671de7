"""Ranking, gaps, bands and order-preserving lists (WN) and set operations (ST)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def topk(df: DataFrame, keys: Keys, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """WN2, WN11: the first k rows of each group; rank: a column for the place. Without a rank Spark limits each group
    before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def top1(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """WN1: the best row of each group."""
    return topk(df, keys, order, 1)


def score_gap(df: DataFrame, keys: Keys, score: str, tie: Sequence[Column] = ()) -> DataFrame:
    """WN3: the best row of each group with gap: its score less the second's (its own score if it is alone)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    ranked = df.withColumn("__rank", F.row_number().over(w)).withColumn("gap", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return ranked.filter("__rank = 1").drop("__rank").withColumn("gap", F.round("gap", 4))


def norm_by_max(df: DataFrame, keys: Keys, col: str, out: str) -> DataFrame:
    """WN4: a column over its group's maximum; a maximum of 0 counts as 1."""
    top = F.max(col).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.round(F.col(col) / F.when(top == 0, F.lit(1.0)).otherwise(top), 4))


def rank_band(df: DataFrame, keys: Keys, score: str, tie: Sequence[Column] = ()) -> DataFrame:
    """WN5: rank, relative score and band: strong in the first 5 with 0.35 of the best, moderate in the first 10 with
    0.2, else weak."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), *tie)))
    out = out.withColumn("relative", F.round(F.coalesce(F.try_divide(F.col(score), F.max(score).over(w)), F.lit(0.0)), 4))
    strong = (F.col("rank") <= 5) & (F.col("relative") >= 0.35)
    moderate = (F.col("rank") <= 10) & (F.col("relative") >= 0.2)
    return out.withColumn("band", F.when(strong, "strong").when(moderate, "moderate").otherwise("weak"))


def with_neighbours(df: DataFrame, keys: Keys, order: str, text: str) -> DataFrame:
    """WN6: prev_text and next_text of each chunk."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("prev_text", F.lag(text).over(w)).withColumn("next_text", F.lead(text).over(w))


def unique_ordered(c: Column) -> Column:
    """WN7: a list without empty entries and repeats, in order."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")))


def assign_codes(df: DataFrame, category: str, order: Sequence[Column], width: int = 3, out: str = "code") -> DataFrame:
    """WN8: LAB-HEM -> LAB-HEM-001, -002, ... within each category."""
    n = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    return df.withColumn(out, F.concat_ws("-", F.col(category), F.lpad(n.cast("string"), width, "0")))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """WN9: page number (from 1) in order, each row with total and has_next. The total is one row, joined."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(total), F.lit(True)).withColumn("has_next", F.col("total") > number * size)


def recent_distinct(df: DataFrame, ts: str, keys: Keys, n: int, tie: Sequence[Column] = ()) -> DataFrame:
    """WN10: one row per keys and minute (the newest), of those the newest n."""
    w = Window.partitionBy(*keys, F.date_trunc("minute", ts)).orderBy(F.col(ts).desc(), *tie)
    once = df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
    return once.orderBy(F.col(ts).desc(), *tie).limit(n)


def keep_latest(df: DataFrame, order: Sequence[Column], n: int, keys: Keys = ()) -> DataFrame:
    """WN12: the newest n rows, of all or of each group."""
    return topk(df, keys, order, n) if keys else df.orderBy(*order).limit(n)


def compare_entities(edges: DataFrame, entity: str, item: str, a, b) -> DataFrame:
    """ST1: for every item of a or b: shared, only_a or only_b."""
    has = lambda x: F.max(F.when(F.col(entity) == F.lit(x), 1).otherwise(0))
    both = edges.filter(F.col(entity).isin(a, b)).groupBy(item).agg(has(a).alias("in_a"), has(b).alias("in_b"))
    kind = F.when((F.col("in_a") == 1) & (F.col("in_b") == 1), "shared").when(F.col("in_a") == 1, "only_a").otherwise("only_b")
    return both.select(item, kind.alias("kind"))


def union_evidence(*frames: DataFrame) -> DataFrame:
    """ST2: evidence rows from all sources under one schema; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_lists(a: Column, b: Column) -> Column:
    """ST3: claim-level and line-level lists as one, each entry once."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))


def diff_assets(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """ST4: key with status added, removed, changed or unchanged."""
    o, n = old.select(key, F.col(digest).alias("old_digest")), new.select(key, F.col(digest).alias("new_digest"))
    status = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest") != F.col("new_digest"), "changed").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, "old_digest", "new_digest", status.alias("status"))
