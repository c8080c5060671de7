from collections import defaultdict

import pytest
from helpers import SCHEMA, clashing, frame, rows, words
from pyspark.sql import functions as F

from claimspark.llm import mixing


def targets(sizes):
    """Targets by rounds: fill what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in order if s not in full}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_copies(spark):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows():
        sizes[source] += len(words(text))
    want = targets(dict(sizes))
    out = mixing.with_copies(frame(spark)).collect()
    assert len(out) == len(rows())
    for r in out:
        assert r["size"] == len(words(r["text"]))
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 3
    again = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.with_copies(frame(spark).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["text"]): r["copies"] for r in out}


def test_taken_comes_near_the_target(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("string")).alias("source"), F.lit(1).alias("n_chars"))
    out = mixing.with_copies(docs, keep=["doc_id", "source"]).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken / r.target - 1) < 0.05 for r in out.collect())


def test_small_sources_come_near_their_targets(spark):
    """Thirty sources of fifty documents with words from 20 to 400: one draw would be off by 10 % and more in some."""
    text = F.repeat(F.lit("w "), (20 + F.pmod(F.xxhash64("id"), F.lit(381))).cast("int"))
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.lpad((F.col("id") % 30).cast("string"), 2, "0")).alias("source"), F.lit(1).alias("n_chars"))
    rows = mixing.with_copies(docs, keep=["doc_id", "source"])
    got = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.03 for r in got)
    assert {r.copies for r in rows.collect()} <= {0, 1, 2, 3}


def test_mix_emits_whole_rows(spark):
    docs = clashing(frame(spark))
    planned = {(r["doc_id"], r["text"], r["source"]): r["copies"] for r in mixing.with_copies(frame(spark)).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    counts = {(r["doc_id"], r["text"], r["source"]): r["n"] for r in got.groupBy("doc_id", "text", "source").agg(F.count("*").alias("n")).collect()}
    times = defaultdict(int)
    for i, t, _, s, _ in rows():
        times[i, t, s] += 1
    assert counts == {k: c * times[k] for k, c in planned.items() if c}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.with_copies(empty).count() == 0 and mixing.mix(empty).count() == 0
