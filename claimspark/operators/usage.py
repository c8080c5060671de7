"""Usage analytics (US), batch form. The expressions are shared with the streaming form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Period -> (number of chart buckets, seconds in one).
PERIODS = {"24h": (24, 3600), "7d": (7, 86400), "30d": (30, 86400), "60d": (60, 86400)}
#: Names of token counts in use -> the names they are normalised to (US8).
TOKEN_NAMES = {
    "input": ("prompt_tokens", "input_tokens"), "output": ("completion_tokens", "output_tokens"), "cached": ("cached_tokens", "cache_read_input_tokens"),
    "reasoning": ("reasoning_tokens",), "cache_creation": ("cache_creation_input_tokens",),
}
ESTIMATE_BUFFER = 2000
COOL_DOWN_MS, MOST_COOL_DOWN_MS = 1000, 120_000


def normalise_usage(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """US8: input, output, cached, reasoning and cache_creation from a map of differing names; 0 counts as missing."""
    get = lambda n: F.nullif(F.element_at(tokens, F.lit(n)), F.lit(0))
    return df.select("*", *[F.coalesce(*[get(n) for n in names], F.lit(0)).cast("long").alias(k) for k, names in TOKEN_NAMES.items()])


def cost() -> Column:
    """US1: cost from token counts and prices per million (p_ columns); missing cached and creation prices fall back to
    the input price, a missing reasoning price to the output price."""
    c = F.col
    or_ = lambda a, b: F.coalesce(F.nullif(c(a), F.lit(0.0)), c(b))
    plain = F.greatest(F.lit(0), c("input") - c("cached")) * c("p_input")
    rest = c("cached") * or_("p_cached", "p_input") + c("output") * c("p_output") + c("reasoning") * or_("p_reasoning", "p_output") + c("cache_creation") * or_("p_cache_creation", "p_input")
    return F.coalesce((plain + rest) / 1_000_000, F.lit(0.0))


def with_cost(usage: DataFrame, prices: DataFrame, keys: Sequence[str] = ("provider", "model")) -> DataFrame:
    """US1: usage with cost. prices(keys, input, cached, output, reasoning, cache_creation)."""
    p = prices.select(*keys, *[F.col(k).cast("double").alias(f"p_{k}") for k in ("input", "cached", "output", "reasoning", "cache_creation")])
    out = usage.join(p, list(keys), "left").withColumn("cost", F.round(cost(), 8))
    return out.drop(*[c for c in p.columns if c.startswith("p_")])


def usage_history(df: DataFrame, start=None, end=None, **equal) -> DataFrame:
    """US2: rows of a time range (ends included) with the given values."""
    for k, v in equal.items():
        df = df.filter(F.col(k) == F.lit(v))
    df = df if start is None else df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    return df if end is None else df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))


def usage_by(df: DataFrame, dims: Sequence[str], tokens: str, price: str) -> DataFrame:
    """US3: requests, tokens, cost and last use by each dimension, all in one pass of grouping sets: dim, key, ..."""
    sets = df.groupingSets([[d] for d in dims], *dims).agg(
        *[F.grouping(d).alias(f"__g_{d}") for d in dims], F.count(F.lit(1)).alias("requests"), F.round(F.sum(tokens), 2).alias("tokens"), F.round(F.sum(price), 6).alias("cost"), F.max("ts").alias("last_used"),
    )
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        name, key = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(name), F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")).otherwise(key)
    return sets.select(name.alias("dim"), key.alias("key"), "requests", "tokens", "cost", "last_used")


def _zero_filled(sums: DataFrame, n: int, values: Sequence[str]) -> DataFrame:
    """Buckets 0 to n - 1, those without rows at 0."""
    every = sums.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(sums, "bucket", "left").na.fill(0, list(values))


def minute_buckets(df: DataFrame, now, value: str, minutes: int = 10) -> DataFrame:
    """US4: the last minutes up to now, one bucket each: bucket (0 the earliest), requests, tokens."""
    end = F.date_trunc("minute", F.lit(now).cast("timestamp"))
    at = (minutes - 1 - (F.unix_timestamp(end) - F.unix_timestamp(F.date_trunc("minute", "ts"))) / 60).cast("int")
    sums = df.withColumn("bucket", at).filter(F.col("bucket").between(0, minutes - 1) & (F.col("ts") <= F.lit(now).cast("timestamp"))).groupBy("bucket").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum(value), 2).alias("tokens"))
    return _zero_filled(sums, minutes, ["requests", "tokens"])


def chart(df: DataFrame, period: str, now, value: str, price: str) -> DataFrame:
    """US5: buckets of a period up to now, counted from its start; what falls on now goes to the last bucket."""
    n, width = PERIODS[period]
    end = F.unix_micros(F.lit(now).cast("timestamp"))
    since = F.unix_micros("ts") - (end - n * width * 1_000_000)
    inside = (since >= 0) & (F.unix_micros("ts") <= end)
    bucket = F.least(F.floor(since / F.lit(width * 1_000_000)), F.lit(n - 1)).cast("int")
    sums = df.filter(inside).groupBy(bucket.alias("bucket")).agg(F.round(F.sum(value), 2).alias("tokens"), F.round(F.sum(price), 6).alias("cost"))
    return _zero_filled(sums, n, ["tokens", "cost"])


def estimate_tokens(request_chars: Column, reply_chars: Column) -> Column:
    """US9: struct<input, output>: a quarter of the characters, rounded up and with a buffer for the input, rounded down
    but 1 at least for the output."""
    return F.struct((F.ceil(request_chars / 4.0) + ESTIMATE_BUFFER).cast("long").alias("input"), F.greatest(F.lit(1), F.floor(reply_chars / 4.0)).cast("long").alias("output"))


def error_streaks(usage: DataFrame, keys: Sequence[str], is_error: Column, tie: str) -> DataFrame:
    """US11: per key its longest run of errors, and for the run it ends in: level, cool-down in ms and release time. A
    success ends a run; runs are numbered by the successes before them."""
    w = Window.partitionBy(*keys).orderBy("ts", tie)
    marked = usage.withColumn("__e", is_error).withColumn("__run", F.sum(F.when(F.col("__e"), 0).otherwise(1)).over(w))
    runs = marked.groupBy(*keys, "__run").agg(F.count_if("__e").alias("level"), F.max(F.when(F.col("__e"), F.col("ts"))).alias("last_error"))
    out = runs.groupBy(*keys).agg(F.max("level").alias("longest"), F.max_by(F.struct("level", "last_error"), "__run").alias("now"))
    wait = F.least(COOL_DOWN_MS * F.pow(F.lit(2.0), F.least("now.level", F.lit(20)).cast("double")), F.lit(float(MOST_COOL_DOWN_MS))).cast("long")
    cool = F.when(F.col("now.level") > 0, wait).otherwise(0)
    return out.select(*keys, "longest", F.col("now.level").alias("level"), cool.alias("cool_down_ms"), F.when(F.col("now.level") > 0, F.timestamp_millis(F.unix_millis("now.last_error") + cool)).alias("release_at"))


def inflight(events: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """US7, batch twin: events(ts, kind: start or finish) with pending: requests in flight after each event, a finish
    without a start leaving it at 0. The running sum less the lowest it fell below 0 before."""
    w = Window.partitionBy(*keys).orderBy("ts", tie)
    total = events.withColumn("__n", F.sum(F.when(F.col("kind") == "start", 1).otherwise(-1)).over(w))
    return total.withColumn("pending", F.col("__n") - F.least(F.min("__n").over(w), F.lit(0))).drop("__n")


def run_status(events: DataFrame, run: str, status: str, order: Sequence[str]) -> DataFrame:
    """US13: the latest status of each run and its number of events."""
    return events.groupBy(run).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("n_events"))
